"""Schemas of the JSON artifacts."""

TRACKS = (
    "video_id string, source string, video_path string, metadata struct<original_fps: double, duration: double, width: int, height: int, total_frames: int, extracted_frames: int>, "
    "timestamps array<double>, vlm_prompts array<string>, num_objects int, objects array<struct<obj_id: int, label string, frames: array<int>, bboxes: array<array<int>>, visible: array<boolean>, confidence: array<double>, mask_areas: array<int>>>, processing_time double"
).replace("label string", "label: string")
REGISTRY = "video_id string, source string, path string, format string"
PREDS = "qa_id string, model string, format string, raw_response string, extracted_answer array<string>, latency_s double, error string"
