"""DuckDB counterparts of the queries that SQL can express."""

_READINGS = """
    WITH objects AS (SELECT DISTINCT video_id, unnest(objects) AS o, timestamps FROM tracks),
    readings AS (
        SELECT video_id, o.obj_id AS obj_id, timestamps, unnest(o.frames) AS frame, unnest(o.bboxes) AS box, unnest(o.visible) AS visible FROM objects
    ),
    before AS (
        SELECT *, lag(frame) OVER w AS f0, lag(box) OVER w AS b0, lag(visible) OVER w AS v0
        FROM readings WINDOW w AS (PARTITION BY video_id, obj_id ORDER BY frame)
    ),
    flagged AS (
        SELECT *, CASE WHEN f0 = frame - 1 AND v0 = visible AND abs(box[1] - b0[1]) <= 2 AND abs(box[2] - b0[2]) <= 2
            AND abs(box[3] - b0[3]) <= 2 AND abs(box[4] - b0[4]) <= 2 THEN 0 ELSE 1 END AS starts FROM before
    ),
    numbered AS (SELECT *, sum(starts) OVER (PARTITION BY video_id, obj_id ORDER BY frame) AS run FROM flagged),
    runs AS (
        SELECT video_id, obj_id, run, min(frame)::BIGINT AS start_frame, max(frame)::BIGINT AS end_frame, count(*) AS n_frames,
            any_value(visible) AS visible, any_value(timestamps)[max(frame) + 1] - any_value(timestamps)[min(frame) + 1] AS duration_s
        FROM numbered GROUP BY video_id, obj_id, run
    )
"""

SQL = {
    "p2_found": _READINGS + "SELECT video_id, obj_id, start_frame, end_frame FROM runs WHERE n_frames >= 2",
    "p2_collapsed": _READINGS + "SELECT video_id, obj_id, start_frame, end_frame, n_frames, visible, duration_s FROM runs",
}
