"""Fixed schemas. Inputs are always read with one of these, never inferred."""

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

CANDIDATE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
    ]
)

# One decision state per record, as the canonical population files store it.
CHOICE_RECORD = T.StructType(
    [
        T.StructField("match_id", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("carrier_xy", T.ArrayType(T.DoubleType())),
        T.StructField("candidate_ids", T.ArrayType(T.StringType())),
        T.StructField("candidate_xy", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("defender_xy", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("target_index", T.IntegerType()),
        T.StructField("target_outside", T.BooleanType()),
    ]
)

# The same record without its label columns, for label-free studies.
GEOMETRY_RECORD = T.StructType(
    [f for f in CHOICE_RECORD.fields if not f.name.startswith("target_")]
)

INTERVAL = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("start_frame", T.LongType()),
        T.StructField("end_frame", T.LongType()),
    ]
)

MATCH_DOCUMENT = T.StructType(
    [
        T.StructField("home_team", T.StructType([T.StructField("id", T.StringType())])),
        T.StructField("away_team", T.StructType([T.StructField("id", T.StringType())])),
        T.StructField("home_team_side", T.ArrayType(T.StringType())),
        T.StructField("pitch_length", T.DoubleType()),
        T.StructField("pitch_width", T.DoubleType()),
        T.StructField(
            "players",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.StringType()),
                        T.StructField("team_id", T.StringType()),
                        T.StructField(
                            "playing_time",
                            T.StructType([T.StructField("by_period", T.ArrayType(INTERVAL))]),
                        ),
                    ]
                )
            ),
        ),
    ]
)

TRACKED_PLAYER = T.StructType(
    [
        T.StructField("player_id", T.StringType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("is_detected", T.BooleanType()),
    ]
)

TRACKING_FRAME = T.StructType(
    [
        T.StructField("frame", T.LongType()),
        T.StructField("period", T.IntegerType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("player_data", T.ArrayType(TRACKED_PLAYER)),
    ]
)

# The event columns an analysis may read.
EVENT_FIELDS = (
    "event_id",
    "event_type",
    "pass_outcome",
    "period",
    "time_end",
    "player_id",
    "player_in_possession_id",
    "player_targeted_id",
)

JOURNAL_RECORD = T.StructType(
    [
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("sequence", T.LongType()),
        T.StructField("previous", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField(
            "payload",
            T.StructType(
                [
                    T.StructField("state", T.StringType()),
                    T.StructField("edge", T.StringType()),
                    T.StructField("candidate", T.StringType()),
                    T.StructField("attempt", T.StringType()),
                    T.StructField("edges", T.ArrayType(T.StringType())),
                ]
            ),
        ),
    ]
)
