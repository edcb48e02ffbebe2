"""Notes (JSON within a string) of the older point format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOTE = (
    "activity string, activity_confidence int, numberOfSteps long, averageActivePace double, currentPace double, currentCadence double, distance double, "
    "customNote string, floorsAscended int, floorsDescended int, currentTripStart string, pressure double, visit string, heartRateS string, heartRateRawS string, "
    "batteryStatus string, networkInfo string, imgb64 string, imgS3 string, lightmeter double, ambient_temp double, humidity double, "
    "accelerometerX double, accelerometerY double, accelerometerZ double, userAccelerometerX double, userAccelerometerY double, userAccelerometerZ double, "
    "gyroscopeX double, gyroscopeY double, gyroscopeZ double, fingerprintHash string, fingerprintHashMD5 string"
)
BATTERY = "level double, status string"
NETWORK = "ssid string, bssid string, ssidData string"
VISIT = "uuid string, name string, arrivalDate string, departureDate string, place string, validVisit boolean"


def parsed(notes: Column) -> Column:
    return F.from_json(notes, NOTE)


def battery(note: Column) -> Column:
    return F.from_json(note["batteryStatus"], BATTERY)


def network(note: Column) -> Column:
    return F.from_json(note["networkInfo"], NETWORK)


def visit(note: Column) -> Column:
    return F.from_json(note["visit"], VISIT)


def has_visit(note: Column) -> Column:
    v = visit(note)
    dated = v["arrivalDate"].isNotNull() | v["departureDate"].isNotNull()
    return F.coalesce(dated & (v["place"] != ""), F.lit(False))


def has_valid_visit(note: Column) -> Column:
    return has_visit(note) & F.coalesce(visit(note)["validVisit"], F.lit(False))


def fingerprint(note: Column) -> Column:
    hashed = note["fingerprintHash"]
    return F.when(F.coalesce(hashed, F.lit("")) != "", hashed).otherwise(note["fingerprintHashMD5"])


def heart_rate(text: Column) -> Column:
    """'76 count/min' gives 76; empty -1; unreadable -2."""
    number = F.split_part(text, F.lit(" "), F.lit(1)).try_cast("double")
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(-1.0)).otherwise(F.coalesce(number, F.lit(-2.0)))
