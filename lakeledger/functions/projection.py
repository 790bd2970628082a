"""US National Atlas equal-area projection (EPSG:2163) as a closed-form column expression."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of EPSG:2163: sphere radius in metres and the projection centre.
RADIUS = 6370997.0
CENTRE_LAT = 45.0
CENTRE_LON = -100.0


def equal_area_xy(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Spherical Lambert azimuthal equal-area (Snyder 1987, eq. 22-4, 24-2, 24-13, 24-14)."""
    sin0, cos0 = math.sin(math.radians(CENTRE_LAT)), math.cos(math.radians(CENTRE_LAT))
    phi, turn = F.radians(lat), F.radians(lon - F.lit(CENTRE_LON))
    toward = F.cos(phi) * F.cos(turn)
    scale = RADIUS * F.sqrt(2.0 / (1.0 + sin0 * F.sin(phi) + cos0 * toward))
    return scale * F.cos(phi) * F.sin(turn), scale * (cos0 * F.sin(phi) - sin0 * toward)
