"""Column types that files are read with."""

RAW_AIS = "CRAFT_ID BIGINT, LON DOUBLE, LAT DOUBLE, COURSE DOUBLE, SPEED DOUBLE, TIMESTAMP STRING, TRACK_ID STRING"
INDICES = "ROUTE_ID STRING, stratum STRING, {flags}, K INT"
INJECTED = (
    "ROUTE_ID STRING, ROUTE_POINT_IDX INT, TIMESTAMP TIMESTAMP_NTZ, CRAFT_ID BIGINT, TRACK_ID STRING, SEG INT, LON DOUBLE, LAT DOUBLE, "
    "SPEED DOUBLE, COURSE_SIN DOUBLE, COURSE_COS DOUBLE, ANOMALY BOOLEAN, T_INDEX INT, ANOMALY_TYPE STRING"
)
