"""Canonical schemas of the tables the operators read and write."""

from pyspark.sql import types as T


def _struct(*fields):
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_S, _D, _L, _I = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()

RESULT_SCHEMA = _struct(
    ("Date", T.DateType()),
    ("value", _D),
    ("units", _S),
    ("wqx_id", _S),
    ("dec_lat_va", _D),
    ("dec_lon_va", _D),
    ("StateCode", _S),
    ("ActivityTypeCode", _S),
    ("ActivityMediaName", _S),
    ("ResultStatusIdentifier", _S),
    ("MonitoringLocationTypeName", _S),
)

SITE_SCHEMA = _struct(
    ("wqx_id", _S),
    ("dec_lat_va", _D),
    ("dec_lon_va", _D),
    ("StateCode", _S),
    ("MonitoringLocationTypeName", _S),
    ("siteType", _S),
)

COUNT_SCHEMA = _struct(
    ("characteristicType", _S),
    ("siteType", _S),
    ("startDate", T.DateType()),
    ("endDate", T.DateType()),
    ("numSites", _L),
    ("numResults", _L),
)

VERTEX_SCHEMA = _struct(("poly_id", _I), ("ftype", _I), ("ring", _I), ("k", _I), ("x", _D), ("y", _D))

POINT = _struct(("x", _D), ("y", _D))

POLY_SCHEMA = _struct(
    ("poly_id", _I),
    ("rings", T.ArrayType(T.ArrayType(POINT))),
    ("bbox", _struct(("xmin", _D), ("ymin", _D), ("xmax", _D), ("ymax", _D))),
)

RESULT_COLUMNS = RESULT_SCHEMA.fieldNames()
