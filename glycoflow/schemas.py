"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

MACROS = T.StructType(
    [
        T.StructField("calories", T.DoubleType()),
        T.StructField("carbs", T.DoubleType()),
        T.StructField("protein", T.DoubleType()),
        T.StructField("fat", T.DoubleType()),
    ]
)

META = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("device", T.StringType()),
        T.StructField("is_finger_prick", T.BooleanType()),
        T.StructField("carbs", T.DoubleType()),
        T.StructField("calories", T.DoubleType()),
        T.StructField("protein", T.DoubleType()),
        T.StructField("fat", T.DoubleType()),
        T.StructField("description", T.StringType()),
        T.StructField("photo_url", T.StringType()),
        T.StructField("alcohol_units", T.DoubleType()),
        T.StructField("alcohol_type", T.StringType()),
        T.StructField("intensity", T.StringType()),
        T.StructField("duration_minutes", T.DoubleType()),
    ]
)

# Stored and exported names of the metadata fields.
META_NAMES = {
    "type": "type",
    "unit": "unit",
    "source": "source",
    "device": "device",
    "is_finger_prick": "isFingerPrick",
    "carbs": "carbs",
    "calories": "calories",
    "protein": "protein",
    "fat": "fat",
    "description": "description",
    "photo_url": "photoUrl",
    "alcohol_units": "alcoholUnits",
    "alcohol_type": "alcoholType",
    "intensity": "intensity",
    "duration_minutes": "durationMinutes",
}

EXPORTED_META = T.StructType([T.StructField(META_NAMES[f.name], f.dataType) for f in META.fields])

EVENTS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("subject_id", T.LongType(), False),
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("value", T.DoubleType()),
        T.StructField("meta", META),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("synced", T.BooleanType()),
    ]
)

# One event as it stands in an exported JSON document.
EXPORTED_EVENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("subjectId", T.LongType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("eventType", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("createdAt", T.StringType()),
        T.StructField("updatedAt", T.StringType()),
        T.StructField("synced", T.BooleanType()),
    ]
)

BACKUP = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("count", T.LongType()),
        T.StructField("events", T.ArrayType(EXPORTED_EVENT)),
        T.StructField("broken", T.StringType()),
    ]
)

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

CURVE_POINTS = T.StructType(
    [
        T.StructField("series_id", T.LongType(), False),
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("value", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)

LIBRE_PAYLOAD = T.StructType(
    [
        T.StructField(
            "data",
            T.StructType(
                [
                    T.StructField(
                        "graphData",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField("Value", T.DoubleType()),
                                    T.StructField("Timestamp", T.StringType()),
                                ]
                            )
                        ),
                    ),
                    T.StructField(
                        "glucoseMeasurement",
                        T.StructType(
                            [
                                T.StructField("Value", T.DoubleType()),
                                T.StructField("Timestamp", T.StringType()),
                                T.StructField("TrendArrow", T.IntegerType()),
                                T.StructField("isHigh", T.BooleanType()),
                                T.StructField("isLow", T.BooleanType()),
                            ]
                        ),
                    ),
                    T.StructField(
                        "sensor", T.StructType([T.StructField("a", T.LongType())])
                    ),
                ]
            ),
        ),
    ]
)

DEXCOM_PAYLOAD = T.ArrayType(
    T.StructType(
        [
            T.StructField("WT", T.StringType()),
            T.StructField("Value", T.DoubleType()),
            T.StructField("Trend", T.IntegerType()),
        ]
    )
)

# A model's reply to a picture of food, and to one of a label.
FOOD_REPLY = T.StructType(
    [
        T.StructField(
            "items",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("quantity", T.DoubleType()),
                        T.StructField("unit", T.StringType()),
                        T.StructField("macros", MACROS),
                        T.StructField("confidence", T.DoubleType()),
                    ]
                )
            ),
        ),
        T.StructField("totalMacros", MACROS),
        T.StructField("confidence", T.DoubleType()),
    ]
)

LABEL_REPLY = T.StructType(
    [
        T.StructField("servingSize", T.StringType()),
        T.StructField("servingsPerContainer", T.DoubleType()),
        T.StructField("macros", MACROS),
        T.StructField("fiber", T.DoubleType()),
        T.StructField("sugar", T.DoubleType()),
        T.StructField("sodium", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)

# `value` stays a string so that "5.6abc" and numbers both arrive; `confidence` keeps its type.
READINGS_PAYLOAD = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField(
            "readings",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("value", T.StringType()),
                        T.StructField("unit", T.StringType()),
                        T.StructField("timestamp", T.StringType()),
                        T.StructField("confidence", T.VariantType()),
                        T.StructField("rawText", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)
