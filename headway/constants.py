"""Fixed values of the search and the street model."""

EARTH_RADIUS_M = 6_371_000.0
ACCESS_S_PER_M = 2.0
WALK_MM_PER_S = 1400
TRANSFER_RADIUS_M = 1000.0
ACCESS_RADIUS_M = 1500.0
MOST_ACCESS_STOPS = 100
NEARBY_RADIUS_M = 1000.0
MOST_NEARBY = 5000
MOST_TRANSFERS = 5
ROUND_DELTA = 3
WALK_SCALARS = (0.5, 1.0, 2.0)
SNAP_RADIUS_M = 50.0
OFF_ROAD_FACTOR = 2
SERVICE_DAYS_BACK, SERVICE_DAYS = 7, 21
DAY_S = 86_400
LAST_SECOND = 4_294_967_295
