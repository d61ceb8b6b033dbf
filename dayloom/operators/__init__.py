"""DataFrame -> DataFrame operators on keyed daily panels."""
