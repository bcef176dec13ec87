"""DuckDB counterparts of the queries over items and predictions."""

from trackloom.plans import sqltext as T

_KEY = r"lower(regexp_replace({0}, '^[\s\p{{Z}}\x{{200B}}\x{{FEFF}}]+|[\s\p{{Z}}\x{{200B}}\x{{FEFF}}]+$', '', 'g'))"
_QA, _MODEL = _KEY.format("qa_id"), _KEY.format("model")
ITEMS = "items AS (SELECT * FROM qa_items WHERE qa_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qa_id) = 1)"
PREDS = f"latest AS (SELECT {_QA} AS qa_id, {_MODEL} AS model, delivery_id, extracted_answer FROM preds QUALIFY row_number() OVER (PARTITION BY {_QA}, {_MODEL} ORDER BY delivered_at DESC, delivery_id DESC) = 1)"
SCORED = f"""WITH {ITEMS}, {PREDS}, scored AS (
    SELECT p.qa_id, p.model, coalesce(i.dim, 'unknown') AS dim, coalesce(i.tier, 'unknown') AS tier, i.format, string_split(i.video_id, '_')[1] AS source,
        CASE WHEN hallucination IN ('variant_a', 'variant_b') THEN hallucination WHEN has_hallucination_distractor THEN 'distractor_only' ELSE 'clean' END AS bucket, p.extracted_answer IS NULL AS invalid,
        coalesce(CASE WHEN i.format LIKE 'ordering%' THEN p.extracted_answer = i.correct_order ELSE p.extracted_answer[1] = i.correct_answer END, false) AS correct
    FROM items i JOIN latest p ON p.qa_id = lower(trim(i.qa_id)))"""
_ANSWER = "coalesce(array_to_string(correct_order, ','), correct_answer)"
_W, _N = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
_EXTRACT = rf"""WITH trimmed AS (SELECT *, regexp_replace(coalesce(raw_response, ''), '^\s+|\s+$', '', 'g') AS t FROM preds),
    tails AS (SELECT *, regexp_replace(regexp_extract(t, '(?is)^.*?</think>(.*)$', 1), '^\s+|\s+$', '', 'g') AS tail FROM trimmed),
    region AS (SELECT *, CASE WHEN tail <> '' THEN tail ELSE regexp_replace(regexp_replace(t, '(?is)<think>.*?</think>', ' ', 'g'), '^\s+|\s+$', '', 'g') END AS f FROM tails),
    tok AS (SELECT *, string_split(upper(trim(regexp_replace(f, '{_N}+', ' ', 'g'))), ' ') AS w,
        upper(regexp_extract(f, '(?i)^[\s*"''`(\[]*(?:answer\s*[:\-]\s*|the\s+answer\s+is\s+|option\s+)?[\s*"''`(\[]*([A-D])(?:{_N}|$)', 1)) AS a, upper(regexp_extract(f, '(?i)(?:^|{_N})([A-D])[\s.)\]"''`]*$', 1)) AS z FROM region),
    parts AS (SELECT *, ltrim(list_filter(w, lambda x: regexp_full_match(x, '[0-9]+'))[1], '0') AS num, list_filter(w, lambda x: x IN ('A', 'B', 'C', 'D')) AS letters FROM tok),
    firsts AS (SELECT *, list_filter(letters, lambda x, i: list_position(letters, x) = i) AS uniq FROM parts),
    answers AS (SELECT *, CASE
        WHEN format = 'mcq_4' THEN CASE WHEN a <> '' THEN a WHEN z <> '' THEN z ELSE letters[1] END
        WHEN format = 'sp' THEN CASE WHEN a IN ('A', 'B') THEN a WHEN z IN ('A', 'B') THEN z ELSE list_filter(letters, lambda x: x IN ('A', 'B'))[1] END
        WHEN format = 'numerical' THEN CASE WHEN regexp_matches(f, '(?i)(?:^|{_N})5\s*(?:or\s*more|more)(?:{_N}|$)') THEN '5 or more' WHEN num IN ('2', '3', '4') THEN num WHEN length(num) > 1 OR num IN ('5', '6', '7', '8', '9') THEN '5 or more' END
        WHEN format = 'ordering_3' AND len(uniq) >= 3 THEN array_to_string(uniq[1:3], ',') WHEN format = 'ordering_4' AND len(uniq) >= 4 THEN array_to_string(uniq[1:4], ',') END AS answer FROM firsts)"""
_PARTS = r"""parsed AS (SELECT video_id, track_ord, o.obj_id AS obj_id, o.label AS label, lower(trim(coalesce(o.label, ''))) AS low FROM objs),
    bared AS (SELECT *, regexp_replace(trim(regexp_replace(low, '#[0-9]+$', '')), '^(the |a |an )', '') AS bare FROM parsed),
    cored AS (SELECT *, trim(regexp_replace(bare, '\s+(?:on|in|at|near|beside|next to|by|of|from|behind|in front of|above|below|under|over)\s+the\s+\w+$', '')) AS core FROM bared),
    labels AS (SELECT video_id, track_ord, obj_id, label, CASE WHEN core <> '' THEN regexp_extract(core, '(\S+)$', 1) ELSE bare END AS base, trim(regexp_replace(core, '\S+$', '')) AS modifiers, regexp_matches(low, '#[0-9]+$') AS digit FROM cored)"""
_PICK = "trim(coalesce(nullif(trim(polished_{0}), ''), nullif(trim({0}), ''), ''))"

SQL = {
    "extracted_answers": _EXTRACT + "SELECT delivery_id, answer FROM answers",
    "extraction_agreement": _EXTRACT + "SELECT format, count(*) AS n, count(*) FILTER (answer IS NOT DISTINCT FROM array_to_string(extracted_answer, ',')) AS same, count(*) FILTER (answer IS NULL) AS none FROM answers GROUP BY format",
    "preds_last_wins": f"WITH {PREDS} SELECT qa_id, model, delivery_id FROM latest",
    "score_items": SCORED + "SELECT qa_id, model, correct, invalid FROM scored",
    "metrics_overall": SCORED + "SELECT model, count(*) AS n_scored, count(*) FILTER (invalid) AS n_invalid, round(avg(correct::INT), 6) AS overall, (SELECT count(*) FROM items) AS n_total, (SELECT count(*) FROM items) - count(*) AS n_missing FROM scored GROUP BY model",
    "metrics_by_group": SCORED + " UNION ALL ".join(f"SELECT model, '{g}' AS grouping, {g} AS value, count(*) AS total, count(*) FILTER (correct) AS n_correct FROM scored GROUP BY model, {g}" for g in ("dim", "tier", "format", "source", "bucket")),
    "metrics_grouping_sets": SCORED + "SELECT dim, tier, format, count(*) AS total, count(*) FILTER (correct) AS n_correct FROM scored GROUP BY GROUPING SETS ((dim), (tier), (format), ())",
    "metrics_macro_dim": SCORED + "SELECT model, round(coalesce(avg(acc) FILTER (n >= 10), 0), 6) AS macro_dim, count(*) FILTER (n >= 10) AS dims FROM (SELECT model, dim, count(*) AS n, avg(correct::INT) AS acc FROM scored GROUP BY ALL) GROUP BY model",
    "metrics_tier_weighted": SCORED + "SELECT model, round(sum(acc * CASE tier WHEN 'tier1' THEN 0.32 WHEN 'tier2' THEN 0.43 WHEN 'tier3' THEN 0.25 ELSE 0 END), 6) AS tier_weighted FROM (SELECT model, tier, avg(correct::INT) AS acc FROM scored GROUP BY ALL) GROUP BY model",
    "metrics_hda": SCORED + "SELECT model, count(*) FILTER (bucket LIKE 'variant%') AS n, round(count(*) FILTER (bucket LIKE 'variant%' AND correct) / nullif(count(*) FILTER (bucket LIKE 'variant%'), 0)::DOUBLE, 6) AS hda FROM scored GROUP BY model",
    "frequency_baseline": f"WITH {ITEMS} SELECT format, {_ANSWER} AS answer, count(*) AS n FROM items GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY format ORDER BY count(*) DESC, min(qa_id)) = 1",
    "answer_distribution": f"WITH {ITEMS} SELECT format, {_ANSWER} AS answer, count(*) AS n FROM items GROUP BY 1, 2",
    "stratified_sample": f"WITH {ITEMS} SELECT qa_id, dim FROM items QUALIFY row_number() OVER (PARTITION BY dim ORDER BY md5('42:' || qa_id)) <= 20",
    "largest_remainder": f"""WITH {ITEMS}, c AS (SELECT dim, count(*) AS k FROM items WHERE dim IS NOT NULL GROUP BY dim), q AS (SELECT dim, k * 100 // (SELECT sum(k) FROM c) AS base, (k * 100) % (SELECT sum(k) FROM c) AS rest FROM c)
        SELECT dim, (base + CASE WHEN row_number() OVER (ORDER BY rest DESC, dim DESC) <= 100 - (SELECT sum(base) FROM q) THEN 1 ELSE 0 END)::BIGINT AS quota FROM q""",
    "balance_answers": f"""WITH {ITEMS}, k AS (SELECT qa_id, dim, hallucination, coalesce(correct_order[1], correct_answer) AS key FROM items WHERE dim IS NOT NULL), n AS (SELECT dim, min(n) AS least FROM (SELECT dim, key, count(*) AS n FROM k WHERE key IS NOT NULL AND hallucination IS NULL GROUP BY ALL) GROUP BY dim)
        SELECT qa_id, dim FROM k WHERE hallucination IS NOT NULL AND key IS NOT NULL UNION ALL SELECT r.qa_id, r.dim FROM (SELECT *, row_number() OVER (PARTITION BY dim, key ORDER BY md5('7:' || qa_id)) AS r FROM k WHERE key IS NOT NULL AND hallucination IS NULL) r JOIN n ON n.dim = r.dim WHERE r.r <= n.least""",
    "video_cap_roundrobin": f"""WITH {ITEMS}, i AS (SELECT qa_id, video_id, dim, hallucination IS NOT NULL AS v FROM items WHERE dim IS NOT NULL AND video_id IS NOT NULL), t AS (SELECT *, row_number() OVER (PARTITION BY video_id, v, dim ORDER BY md5('5:' || qa_id)) AS rn FROM i)
        SELECT qa_id, video_id FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY v DESC, rn, md5('5:' || dim), qa_id) AS turn FROM t) WHERE turn <= 8 OR v""",
    "option_shuffle": f"""WITH {ITEMS}, o AS (SELECT qa_id, [option_a, option_b, option_c, option_d][ascii(correct_answer) - 64] AS good, unnest([option_a, option_b, option_c, option_d]) AS text, unnest([0, 1, 2, 3]) AS k FROM items
            WHERE format = 'mcq_4' AND option_a IS NOT NULL AND option_b IS NOT NULL AND option_c IS NOT NULL AND option_d IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY qa_id ORDER BY md5('3:' || qa_id || ':' || text), k) AS r FROM o)
        SELECT qa_id, string_agg(text, '|' ORDER BY r) AS options, min(CASE WHEN text = good THEN chr((64 + r)::INT) END) AS answer FROM r GROUP BY qa_id""",
    "ordering_validity": f"""WITH {ITEMS} SELECT qa_id, CASE WHEN correct_order IS NULL OR len(correct_order) = 0 THEN 'missing' WHEN len(correct_order) <> regexp_extract(format, '([0-9]+)$', 1)::INT THEN 'length' WHEN len(list_distinct(correct_order)) <> len(correct_order) THEN 'repeated'
        WHEN len(list_filter(correct_order, lambda x: x NOT IN ('A', 'B', 'C', 'D'))) > 0 THEN 'letter' ELSE 'ok' END AS reason FROM items WHERE format LIKE 'ordering%'""",
    "item_verification": f"""WITH {ITEMS}, w AS (SELECT *, list_distinct(string_split(trim(regexp_replace(lower(coalesce(question, '')), '[^a-z0-9]+', ' ', 'g')), ' ')) AS a, list_distinct(string_split(trim(regexp_replace(lower(coalesce(polished_question, '')), '[^a-z0-9]+', ' ', 'g')), ' ')) AS b,
            list_filter([polished_option_a, polished_option_b, polished_option_c, polished_option_d], lambda x: x IS NOT NULL) AS o, length(polished_statement_a) / greatest(1, length(polished_statement_b))::DOUBLE AS ratio FROM items)
        SELECT qa_id, array_to_string(list_filter([CASE WHEN coalesce(polished_question, '') = '' THEN 'no_question' END, CASE WHEN length(polished_question) < 5 THEN 'short_question' END, CASE WHEN len(list_intersect(a, b)) / greatest(1, len(a))::DOUBLE < 0.25 THEN 'low_overlap' END,
            CASE WHEN len(list_distinct(o)) < len(o) THEN 'repeated_options' END, CASE WHEN ratio > 3 OR ratio < 1 / 3.0 THEN 'statement_ratio' END], lambda x: x IS NOT NULL), ',') AS issues FROM w""",
    "label_parse": f"WITH {T.OBJECTS}, {_PARTS} SELECT video_id, obj_id, label, base, modifiers, digit FROM labels",
    "sibling_groups": f"WITH {T.OBJECTS}, {_PARTS} SELECT video_id, base, count(*) AS n, string_agg(obj_id::VARCHAR, ',' ORDER BY obj_id) AS members FROM labels WHERE base <> '' GROUP BY ALL HAVING count(*) >= 2",
    "label_numbering": f"WITH {T.OBJECTS}, b AS (SELECT video_id, track_ord, o.obj_id AS obj_id, regexp_replace(o.label, '\\s*#[0-9]+$', '') AS bare FROM objs), r AS (SELECT *, row_number() OVER (PARTITION BY video_id, bare ORDER BY track_ord) AS r FROM b) SELECT video_id, obj_id, CASE WHEN r > 1 THEN bare || ' #' || r ELSE bare END AS label FROM r",
    "resume_todo": f"WITH {ITEMS}, m AS (SELECT DISTINCT {_MODEL} AS model FROM model_registry), done AS (SELECT DISTINCT {_QA} AS qa_id, {_MODEL} AS model FROM preds WHERE error IS NULL AND qa_id IS NOT NULL), c AS (SELECT qa_id, count(*) AS done FROM done WHERE model IN (SELECT model FROM m) GROUP BY 1), i AS (SELECT DISTINCT {_QA} AS qa_id FROM items) SELECT i.qa_id, (SELECT count(*) FROM m) - coalesce(done, 0) AS todo FROM i LEFT JOIN c USING (qa_id) WHERE (SELECT count(*) FROM m) > coalesce(done, 0)",
    "shard_slice": f"WITH {ITEMS} SELECT qa_id, floor((row_number() OVER (ORDER BY qa_id) - 1) / ceil(count(*) OVER () / 4.0))::INT AS shard FROM items",
    "frame_sampling": f"WITH {T.DOCS}, n AS (SELECT video_id, len(timestamps) AS n, unnest(range(0, 8)) AS i FROM docs WHERE len(timestamps) > 1) SELECT video_id, i::INT AS i, (i * (n - 1) // 7)::INT AS inclusive, (i * n // 8)::INT AS exclusive FROM n",
    "hallucination_roll": f"WITH {ITEMS}, u AS (SELECT qa_id, ('0x' || substr(md5('11:' || qa_id), 1, 8))::UBIGINT / 4294967296.0 AS u FROM items) SELECT qa_id, CASE WHEN u < 0.05 THEN 'question' WHEN u < 0.15 THEN 'distractor' ELSE 'none' END AS roll FROM u",
    "subset_overlap": f"WITH {ITEMS} SELECT video_id FROM items WHERE tier = 'tier1' AND video_id IS NOT NULL INTERSECT SELECT video_id FROM items WHERE tier = 'tier2' AND video_id IS NOT NULL",
    "light_polish": f"""WITH {ITEMS}, c AS (SELECT qa_id, upper(substr(trim(question), 1, 1)) || substr(trim(question), 2) AS c FROM items WHERE question IS NOT NULL)
        SELECT qa_id, CASE WHEN regexp_matches(c, '[.?!]$') THEN c WHEN regexp_matches(lower(c), '^(what|which|when|where|who|why|how|does|do|did|is|are|was|were|of|in|at|on|for|during|once)\\b') THEN c || '?' ELSE c || '.' END AS text FROM c""",
    "clean_projection": f"WITH {ITEMS} SELECT qa_id, format, {_PICK.format('question')} AS question, {', '.join(_PICK.format(f'option_{x}') + f' AS option_{x}' for x in 'abcd')}, {_ANSWER} AS answer FROM items",
    "registry_status": "SELECT source, format, count(*) AS n, count(DISTINCT video_id) AS videos FROM (SELECT * FROM video_registry WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path) = 1) GROUP BY ALL",
}
