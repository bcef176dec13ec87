"""Common table expressions of the DuckDB counterparts. Written independently of the DataFrame operators."""

DOCS = "docs AS (SELECT * FROM tracks WHERE video_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY processing_time) = 1)"
OBJECTS = (
    DOCS
    + """, objs AS (
    SELECT video_id, source, metadata.width AS width, metadata.height AS height, metadata.duration AS duration, len(timestamps) AS n_video, k - 1 AS track_ord, objects[k] AS o
    FROM (SELECT *, unnest(range(1, len(objects) + 1)) AS k FROM docs))"""
)
FRAMES = (
    OBJECTS
    + """, frames AS (
    SELECT video_id, width, height, n_video, track_ord, o.obj_id AS obj_id, o.label AS label, o.frames[i] AS frame, o.bboxes[i][1] AS x1, o.bboxes[i][2] AS y1,
        o.bboxes[i][3] AS x2, o.bboxes[i][4] AS y2, o.visible[i] AS visible, o.confidence[i] AS confidence, o.mask_areas[i] AS area
    FROM (SELECT *, unnest(range(1, len(o.frames) + 1)) AS i FROM objs))"""
)
STATES = (
    FRAMES
    + """, based AS (
    SELECT *, coalesce(quantile_cont(CASE WHEN visible AND area > 0 THEN area END, 0.5) OVER (PARTITION BY video_id, obj_id ORDER BY frame ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
        first_value(CASE WHEN visible AND area > 0 THEN area END IGNORE NULLS) OVER (PARTITION BY video_id, obj_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0)::DOUBLE AS baseline
    FROM frames),
    states AS (
    SELECT *, CASE WHEN NOT coalesce(visible, false) OR coalesce(area, 0) = 0 THEN 'invisible' WHEN baseline <= 0 THEN 'normal' WHEN area / baseline < 0.1 THEN 'invisible'
        WHEN area / baseline < 0.5 THEN 'partial' ELSE 'normal' END AS state FROM based)"""
)
RUNS = (
    STATES
    + """, marked AS (
    SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER w THEN 1 ELSE 0 END AS changed, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1, lag(x2) OVER w AS px2, lag(y2) OVER w AS py2,
        sum((state <> 'invisible')::INT) OVER (PARTITION BY video_id, obj_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS ahead
    FROM states WINDOW w AS (PARTITION BY video_id, obj_id ORDER BY frame)),
    numbered AS (SELECT *, sum(changed) OVER (PARTITION BY video_id, obj_id ORDER BY frame) AS run FROM marked),
    runs AS (
    SELECT video_id, obj_id, run, state, any_value(width) AS width, any_value(height) AS height, any_value(n_video) AS n_video, any_value(track_ord) AS track_ord, any_value(label) AS label,
        min(frame) AS s, max(frame) AS e, count(*) AS n, arg_min(ahead, frame) AS ahead, arg_min(px1, frame) AS px1, arg_min(py1, frame) AS py1, arg_min(px2, frame) AS px2, arg_min(py2, frame) AS py2,
        arg_min(x1, frame) AS fx1, arg_min(y1, frame) AS fy1, arg_min(x2, frame) AS fx2, arg_min(y2, frame) AS fy2
    FROM numbered GROUP BY video_id, obj_id, run, state)"""
)
EVENTS = (
    "WITH RECURSIVE "
    + RUNS
    + """, near AS (
    SELECT *, (fx1 < width * 0.05 OR fy1 < height * 0.05 OR fx2 > width * 0.95 OR fy2 > height * 0.95) AS border,
        (px1 < width * 0.05 OR py1 < height * 0.05 OR px2 > width * 0.95 OR py2 > height * 0.95) AS left_at_border FROM runs),
    around AS (
    SELECT *, lead(s) OVER w AS next_s, lead(ahead) OVER w AS next_ahead, lead(border) OVER w AS next_border,
        max((state <> 'invisible')::INT) OVER (PARTITION BY video_id, obj_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
    FROM near WINDOW w AS (PARTITION BY video_id, obj_id ORDER BY run)),
    gone AS (SELECT *, CASE WHEN left_at_border THEN 'exit_frame' ELSE 'full_occlusion' END AS kind FROM around WHERE state = 'invisible' AND n >= 2 AND before = 1),
    jumps AS (
    SELECT * FROM (
        SELECT video_id, obj_id, track_ord, n_video, label, frame, state <> 'invisible' AND lag(state) OVER w <> 'invisible' AS shown,
            CASE WHEN lag(area) OVER w > 0 THEN abs(area - lag(area) OVER w) / (lag(area) OVER w)::DOUBLE END AS grown,
            sqrt(pow((x1 + x2 - lag(x1) OVER w - lag(x2) OVER w) / 2.0, 2) + pow((y1 + y2 - lag(y1) OVER w - lag(y2) OVER w) / 2.0, 2)) / sqrt(pow(width, 2) + pow(height, 2)) AS shift
        FROM states WINDOW w AS (PARTITION BY video_id, obj_id ORDER BY frame))
    WHERE shown AND (grown > 0.8 OR shift > 0.4)),
    kept AS (
    SELECT j.* FROM jumps j JOIN (SELECT video_id, obj_id, min(frame) AS frame FROM jumps GROUP BY ALL) USING (video_id, obj_id, frame)
    UNION ALL
    SELECT j.* FROM kept k, LATERAL (SELECT * FROM jumps x WHERE x.video_id = k.video_id AND x.obj_id = k.obj_id AND x.frame >= k.frame + 5 ORDER BY x.frame LIMIT 1) j),
    overlap AS (
    SELECT * FROM (
        SELECT a.video_id, a.frame, a.n_video, a.track_ord AS ta, b.track_ord AS tb, a.obj_id AS oa, b.obj_id AS ob, a.label AS la, b.label AS lb,
            greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS inter,
            greatest(0, a.x2 - a.x1) * greatest(0, a.y2 - a.y1) + greatest(0, b.x2 - b.x1) * greatest(0, b.y2 - b.y1) AS areas
        FROM frames a JOIN frames b ON a.video_id = b.video_id AND a.frame = b.frame AND a.track_ord < b.track_ord AND a.visible AND b.visible)
    WHERE areas - inter > 0 AND inter / (areas - inter)::DOUBLE > 0.05),
    lengths AS (SELECT video_id, obj_id, count(*) AS n FROM frames GROUP BY ALL),
    touches AS (
    SELECT i.*, la.n AS na, lb.n AS nb FROM (
        SELECT video_id, oa, ob, any_value(ta) AS ta, any_value(tb) AS tb, any_value(la) AS la, any_value(lb) AS lb, any_value(n_video) AS n_video, min(frame) AS s, max(frame) AS e, count(*) AS n, avg(inter / (areas - inter)::DOUBLE) AS iou
        FROM (SELECT *, frame - row_number() OVER (PARTITION BY video_id, oa, ob ORDER BY frame) AS island FROM overlap) GROUP BY video_id, oa, ob, island) i
        JOIN lengths la ON la.video_id = i.video_id AND la.obj_id = i.oa JOIN lengths lb ON lb.video_id = i.video_id AND lb.obj_id = i.ob
    WHERE i.n >= 3 AND i.n / least(la.n, lb.n)::DOUBLE <= 0.8),
    raw_events AS (
    SELECT video_id, CASE WHEN border THEN 'enter_frame' ELSE 'appear' END AS type, obj_id, NULL::INT AS other, s AS frame, NULL::INT AS s, NULL::INT AS e, track_ord, 0::BIGINT AS emit, n_video, label, NULL::VARCHAR AS other_label, NULL::VARCHAR AS after_event, NULL::DOUBLE AS detail
        FROM around WHERE state <> 'invisible' AND coalesce(before, 0) = 0 AND s > 2
    UNION ALL SELECT video_id, 'partial_occlusion', obj_id, NULL, NULL, s, e, track_ord, 1 + s * 4, n_video, label, NULL, NULL, NULL FROM around WHERE state = 'partial' AND n >= 2
    UNION ALL SELECT video_id, kind, obj_id, NULL, NULL, s, e, track_ord, 1 + s * 4, n_video, label, NULL, NULL, NULL FROM gone
    UNION ALL SELECT video_id, 'disappear', obj_id, NULL, s, NULL, NULL, track_ord, 3 + s * 4, n_video, label, NULL, kind, NULL FROM gone WHERE next_s IS NULL
    UNION ALL SELECT video_id, 'enter_frame', obj_id, NULL, next_s, NULL, NULL, track_ord, 2 + s * 4, n_video, label, NULL, kind, NULL FROM gone WHERE next_ahead >= 2 AND next_border
    UNION ALL SELECT video_id, 'reappear', obj_id, NULL, next_s, NULL, NULL, track_ord, 3 + s * 4, n_video, label, NULL, kind, n FROM gone WHERE next_ahead >= 2
    UNION ALL SELECT video_id, 'state_change', obj_id, NULL, frame, NULL, NULL, track_ord, 1000000000 + frame, n_video, label, NULL, NULL, CASE WHEN grown > 0.8 THEN grown ELSE shift END FROM kept
    UNION ALL SELECT video_id, 'interaction', oa, ob, NULL, s, e, ta, 2000000000 + tb * 100000 + s, n_video, la, lb, NULL, iou FROM touches),
    events_of AS (
    SELECT *, coalesce(frame, s) AS first_frame, coalesce(frame, (s + e) // 2) AS mid, row_number() OVER (PARTITION BY video_id ORDER BY coalesce(frame, s), other IS NOT NULL, track_ord, emit) - 1 AS event_id,
        CASE WHEN n_video <= 1 THEN 'beginning' WHEN coalesce(frame, (s + e) // 2) / (n_video - 1)::DOUBLE < 0.25 THEN 'beginning' WHEN coalesce(frame, (s + e) // 2) / (n_video - 1)::DOUBLE < 0.5 THEN 'early'
            WHEN coalesce(frame, (s + e) // 2) / (n_video - 1)::DOUBLE < 0.75 THEN 'late' ELSE 'end' END AS temporal_position
    FROM raw_events)"""
)
TOUCHING = EVENTS + ", touching AS (SELECT video_id, obj_id, label, type, first_frame, mid, s, e, event_id, other FROM events_of UNION ALL SELECT video_id, other, other_label, type, first_frame, mid, s, e, event_id, other FROM events_of WHERE other IS NOT NULL)"
