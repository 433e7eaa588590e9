"""Declared schemas of every input. Nothing is inferred inside a job."""

from __future__ import annotations

MEMBERS = list(range(15))
WEATHER_VARIABLES = ["ws10m", "wd10m", "t2m", "rh2m", "mslp", "g10m"]
AREAS = [f"ELSPOT NO{k}" for k in range(1, 5)]


def names(flat_ddl: str) -> list[str]:
    """Column names of a schema without nested types."""
    return [part.strip().rsplit(" ", 1)[0].strip("`") for part in flat_ddl.split(",")]


FORECAST_WIDE = "sid string, time_ref timestamp, time timestamp, lt long, " + ", ".join(
    f"{variable}_{em:02d} double" for variable in WEATHER_VARIABLES for em in MEMBERS
)

NOWCAST = (
    "windpark string, time timestamp, air_temperature_2m double, air_pressure_at_sea_level double,"
    "relative_humidity_2m double, precipitation_amount double, wind_speed_10m double,"
    "wind_direction_10m double"
)

AREA_POWER_WIDE = "__index_level_0__ timestamp, " + ", ".join(f"`{area}` double" for area in AREAS)

UNITS = (
    "windpark_nve_id long, windpark_nve string, windpark_statnet string, bidding_area string,"
    "province string, county string, production_start_date timestamp,"
    "reported_operating_power_max double, operating_power_max double, mean_hub_height double,"
    "mean_production double, mean_rotor_diameter double, num_turbines long, elevation double,"
    "ruggedness double"
)

LOOKUP = (
    "windpark_nve_id long, windpark_nve string, windpark_statnet string, bidding_area string,"
    "eic_code string"
)

PERIOD = (
    "struct<unavailableCapacity:double,availableCapacity:double,eventStart:string,eventStop:string>"
)
UNIT_OUTAGE = (
    "struct<name:string,eic:string,fuelType:int,areaEic:string,areaName:string,"
    f"installedCapacity:double,timePeriods:array<{PERIOD}>>"
)
TRANSMISSION_OUTAGE = (
    "struct<inAreaEic:string,inAreaName:string,outAreaEic:string,outAreaName:string,"
    f"installedCapacity:double,timePeriods:array<{PERIOD}>>"
)
NAMED_CODE = "struct<name:string,code:string>"
MESSAGE = (
    "messageId string, messageType int, unavailabilityType int, reasonCode string,"
    "unavailabilityReason string, remarks string, publicationDate string, publisherId string,"
    "publisherName string, eventStart string, eventStop string,"
    f"productionUnits array<{UNIT_OUTAGE}>, generationUnits array<{UNIT_OUTAGE}>,"
    f"transmissionUnits array<{TRANSMISSION_OUTAGE}>, areas array<{NAMED_CODE}>,"
    f"assets array<{NAMED_CODE}>"
)
FIELDS = MESSAGE.replace(" string", ":string").replace(" int", ":int").replace(" array", ":array")
PAGE = f"total long, items array<struct<{FIELDS}>>"

REGISTER = (
    "VindkraftAnleggId long, Navn string, IdriftsettelseForsteByggetrinn string,"
    "InstallertEffekt_MW double, Fylke string, Kommune string, GjsnittNavhoeyde double,"
    "GjsnittGeneratorytelse double, GjsnittRotordiameter double, AntallOperativeTurbiner long,"
    "Turbiner array<struct<TurbinType:string,TurbinStorrelse_kW:double,AntallTurbiner:long>>"
)
