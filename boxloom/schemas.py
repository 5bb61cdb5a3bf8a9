"""Explicit schemas of every relation; nothing is inferred on read."""

from pyspark.sql import types as T

BOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")])
IMAGES = T.StructType([T.StructField("image_key", T.StringType()), T.StructField("png", T.BinaryType()), T.StructField("caption", T.StringType())])
CAPTIONS = T.StructType([T.StructField(c, T.StringType()) for c in ("new_key", "web_caption", "vlm_caption")])
PHASE1 = T.StructType([T.StructField(c, T.StringType()) for c in ("new_key", "web_caption", "vlm_caption", "processed_vlm_caption", "llama3_phase1_original_answer", "llama3_phase1_original_attributes", "llama3_phase1_attributes")])
PHASE2 = T.StructType(PHASE1.fields + [T.StructField(c, T.StringType()) for c in ("llama3_phase2_original_answer", "llama3_phase2_original_attributes", "llama3_phase2_attributes", "llama3_phase2_final_merge")])
DETECTOR = T.StructType(
    [
        T.StructField("new_key", T.StringType()),
        T.StructField("OV_to_detect", T.ArrayType(T.StringType())),
        T.StructField("bboxes", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("scores", T.ArrayType(T.DoubleType())),
        T.StructField("labels", T.ArrayType(T.IntegerType())),
    ]
)
DETECTIONS = T.StructType([T.StructField("image_id", T.LongType()), T.StructField("detector", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType()), *BOX.fields])
SAMPLES = T.StructType(
    [
        T.StructField("new_key", T.StringType()),
        T.StructField("sub_sample", T.IntegerType()),
        T.StructField("image_size", T.ArrayType(T.IntegerType())),
        T.StructField("model_type", T.StringType()),
        T.StructField("annotation_type", T.StringType()),
        T.StructField("OV_merged", T.ArrayType(T.StringType())),
        T.StructField("bboxes", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("scores", T.ArrayType(T.DoubleType())),
        T.StructField("ovd_belonging", T.ArrayType(T.StringType())),
        T.StructField("ovd_source", T.ArrayType(T.StringType())),
    ]
)
IMAGE_DIRS = T.MapType(T.StringType(), T.StringType())
WORK_MAP = T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))
