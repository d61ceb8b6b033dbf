"""Explicit schemas of the inputs (DDL strings, as ``spark.read.schema`` takes them)."""

API_RECORD = (
    "Country string, CountryCode string, Province string, City string, CityCode string, "
    "Lat double, Lon double, Confirmed int, Deaths int, Recovered int, Active int, "
    "Date string, LocationID string"
)

API_RECORD_LONG = (
    "Country string, Province string, Lat double, Lon double, Date string, Cases double, Status string"
)

STORED_DOCUMENT = (
    "_id string, Country string, CountryCode string, Province array<string>, City string, "
    "CityCode string, Location string, Confirmed int, Deaths int, Recovered int, Active int, Date string"
)

DAILY_PANEL = (
    "Country string, Province string, Date date, DateInt double, "
    "Confirmed bigint, Deaths bigint, Recovered bigint"
)

LABEL_DICTIONARY = "Country string, CountryIndex bigint"

PAIR_DICTIONARY = (
    "Country_Region string, Country_RegionIndex double, Province_State string, Province_StateIndex double"
)

TRAINING_TABLE = (
    "Id int, Province_State string, Country_Region string, Date date, "
    "ConfirmedCases double, Fatalities double"
)

REQUEST_TABLE = "ForecastId int, Province_State string, Country_Region string, Date date"

ENCODED_PANEL = (
    "Country_RegionIndex double, Province_StateIndex double, Date date, "
    "ConfirmedCases double, Fatalities double"
)

GROUPED_TABLE = (
    "Country string, CountryCode string, Date date, Confirmed float, Deaths float, Recovered float"
)

WORLD_FORECAST = (
    "ds date, confirmed float, deaths float, recovered float, "
    "confirmed_yhat float, confirmed_yhat_lower float, confirmed_yhat_upper float, "
    "deaths_yhat float, deaths_yhat_lower float, deaths_yhat_upper float, "
    "recovered_yhat float, recovered_yhat_lower float, recovered_yhat_upper float"
)

HIGH_WATER_MARK = "mark timestamp_ntz"

#: One row per mark, start or end of a load; ``mark`` is set where the row moves it.
LOAD_JOURNAL = (
    "mark timestamp_ntz, load bigint, state string, begins timestamp_ntz, accepted bigint, rejected bigint, inputs string"
)
