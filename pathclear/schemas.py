"""Schemas of the rows that cross a boundary: input frames, analyses, decisions and exports."""

FRAME_KEY = ["source", "session", "frame_sequence"]

POINT = "struct<x:double,y:double,z:double>"
FRAME_INPUT = (
    f"source string, session long, frame_sequence long, bag_stamp_ns long, "
    f"measurement_time_ns long, points array<{POINT}>, transform_available boolean, "
    "rotation array<double>, translation array<double>, calibration_verified boolean, "
    "allow_unverified_calibration boolean"
)
CANDIDATE = (
    "struct<id:int,distance_m:double,distance_valid:boolean,support_points:long,"
    "center:array<double>,size:array<double>,nearest:array<double>,channels:int,edge:boolean,"
    "closest_offset_m:double>"
)
TRACK = (
    "struct<id:long,confirmed:boolean,coasting:boolean,hits:int,age:int,distance_m:double,"
    "center:array<double>,size:array<double>,channels:int>"
)
ROUTE = "struct<c0:double,c1:double,c2:double,valid:boolean,max_x:double,rail_slices:int>"

# What the decision needs of an analysis, and what it returns.
ANALYSIS = (
    "source string, session long, frame_sequence long, measurement_time_ns long, status int, "
    "reason string, calibration_trust string, evaluation_region_valid boolean, "
    "evaluated_range_m double, ego_motion_valid boolean, ego_speed_mps double, "
    f"candidates array<{CANDIDATE}>"
)
ASSESSMENT = (
    "source string, session long, frame_sequence long, measurement_time_ns long, state string, "
    "reason string, distance_m double, distance_valid boolean, calibration_trust string, "
    f"tracks array<{TRACK}>"
)

# Exported frame rows, one JSON object per line.  ``route`` mixes numbers and a boolean.
EXPORT_OBJECT = (
    "struct<id:long,confirmed:boolean,coasting:boolean,hits:int,age:int,distance_m:double,"
    "support_points:long,center:array<double>,size:array<double>,channels:int,edge:boolean,"
    "closest_offset_m:double>"
)
EXPORT = (
    "schema_version int, mode string, bag_id string, session_id long, frame_sequence long, "
    "measurement_stamp_ns long, bag_stamp_ns long, state string, reason string, "
    "distance_m double, distance_valid boolean, candidate_count int, "
    f"candidates array<{EXPORT_OBJECT}>, evaluation_region_valid boolean, "
    "evaluated_range_m double, ego_motion_valid boolean, ego_speed_mps double, "
    f"ground_inliers long, ground_plane array<double>, tracks array<{EXPORT_OBJECT}>, "
    "route array<string>, processing_status int, calibration_trust int, "
    "transform_applied boolean, calibration_verified boolean, calibration_assumed boolean, "
    "geometry_point_count long, detection_point_count long, invalid_point_count long, "
    "blind_point_count long, outside_roi_point_count long, processing_ms double"
)

# Raw cloud messages as they are exchanged.
CLOUD_FIELD = "struct<name:string,offset:int,datatype:int,count:int>"
CLOUD = (
    "source string, session long, frame_sequence long, bag_stamp_ns long, stamp_sec long, "
    "stamp_nanosec long, frame_id string, width long, height long, point_step long, "
    f"row_step long, is_bigendian boolean, fields array<{CLOUD_FIELD}>, data binary"
)
