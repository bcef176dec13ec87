import os
import sys

import pytest

os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 4g pyspark-shell")
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def track(video_id, objects, source="s", width=100, height=100, n=None, duration=10.0):
    """A track document; objects: (obj_id, label, frames, boxes, visible)."""
    n = n if n is not None else max((max(o[2]) + 1 for o in objects if o[2]), default=0)
    return {
        "video_id": video_id, "source": source, "video_path": None, "metadata": {"original_fps": 30.0, "duration": duration, "width": width, "height": height, "total_frames": n, "extracted_frames": n},
        "timestamps": [i / 3 for i in range(n)], "vlm_prompts": [], "num_objects": len(objects), "processing_time": 1.0,
        "objects": [{"obj_id": i, "label": lab, "frames": f, "bboxes": b, "visible": v, "confidence": [0.9] * len(f), "mask_areas": [100 if x else 0 for x in v]} for i, lab, f, b, v in objects],
    }


@pytest.fixture(scope="session")
def tracks(spark):
    from trackloom import schemas

    return lambda docs: spark.createDataFrame(docs, schemas.TRACKS)
