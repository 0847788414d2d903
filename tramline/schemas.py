"""Explicit schemas of the named tables, so no reader has to infer them."""

from pyspark.sql import types as T


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


LONG, TEXT, INT, BOOL, DOUBLE, TIME = (
    T.LongType(), T.StringType(), T.IntegerType(), T.BooleanType(), T.DoubleType(), T.TimestampType(),
)
MONEY = T.DecimalType(10, 2)

STATIONS = _struct(
    id=LONG, name=TEXT, station_address=TEXT, station_latitude=TEXT, station_longitude=TEXT,
    gtfs_stop_id=TEXT, gtfs_source=TEXT, is_bus_stop=BOOL, created_at=TIME,
)
ROUTES = _struct(
    id=LONG, gtfs_route_id=TEXT, short_name=TEXT, long_name=TEXT, route_type=INT,
    source=TEXT, agency_id=TEXT, created_at=TIME,
)
AGENCY = _struct(agency_id=TEXT, agency_name=TEXT)
TRIPS = _struct(
    id=LONG, gtfs_trip_id=TEXT, route_id=LONG, start_station_id=LONG, destination_id=LONG,
    transport_type=TEXT, trip_headsign=TEXT, direction_id=INT, created_at=TIME,
)
FARES = _struct(
    id=LONG, start_station_id=LONG, end_station_id=LONG, fare_amount=MONEY,
    transport_type=TEXT, created_at=TIME,
)
STOP_TIMES = _struct(
    trip_id=TEXT, stop_id=TEXT, stop_sequence=INT, arrival_time=TEXT, departure_time=TEXT,
)
QA_CORPUS = _struct(question=TEXT, answer=TEXT, context=TEXT, type=TEXT)
FEEDBACK = _struct(question=TEXT, answer=TEXT, rating=INT, feedback=TEXT)
SYNC_LOG = _struct(dataset=TEXT, synced_at=TIME)

TABLES = {"stations": STATIONS, "routes": ROUTES, "trips": TRIPS, "fares": FARES}

MESSAGE = _struct(
    **{"id": TEXT, "from": TEXT, "type": TEXT, "timestamp": TEXT, "text": _struct(body=TEXT)}
)
CONTACT = _struct(wa_id=TEXT, profile=_struct(name=TEXT))
PAYLOAD = _struct(
    entry=T.ArrayType(_struct(
        changes=T.ArrayType(_struct(
            value=_struct(messages=T.ArrayType(MESSAGE), contacts=T.ArrayType(CONTACT))
        ))
    ))
)
