"""DuckDB SQL for the queries of the catalog, on the same tables."""

# What counts as blank, and, further down, the rules' numbers, patterns and stop words.
_BLANK = r"[\s\x0B\p{Zs}\x{2028}\x{2029}\x{FEFF}]"
_TRIM = lambda c: f"regexp_replace({c}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"
_DIFFS = """
d0 AS (SELECT user_id AS recording_id, row_number() OVER w - 1 AS seq, value, lag(value) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
d AS (SELECT recording_id, seq, seq * 0.25::DOUBLE AS t, coalesce(floor(abs(value - before) * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE, 0.0::DOUBLE) AS diff FROM d0)"""
_RAW = f"""{_DIFFS},
s AS (
  SELECT recording_id, seq, t, t AS st, 'start' AS reason, 0.0::DOUBLE AS score, 0.0::DOUBLE AS dsum, 0::BIGINT AS n, 0.0::DOUBLE AS dmax, (diff >= 13.3333)::INT AS run,
    NULL::DOUBLE AS c_start, NULL::DOUBLE AS c_end, NULL::VARCHAR AS c_reason, NULL::DOUBLE AS c_score, NULL::DOUBLE AS c_sum, NULL::BIGINT AS c_n, NULL::DOUBLE AS c_max
  FROM d WHERE seq = 0
  UNION ALL
  SELECT recording_id, seq, t, CASE WHEN cut > 0 THEN t ELSE st END, CASE cut WHEN 1 THEN CASE WHEN run >= 3 THEN 'motion' ELSE 'scene_change' END WHEN 2 THEN 'cadence' ELSE reason END,
    CASE WHEN cut > 0 THEN diff ELSE score END, CASE WHEN cut > 0 THEN 0 ELSE dsum + diff END, CASE WHEN cut > 0 THEN 0 ELSE n + 1 END, CASE WHEN cut > 0 THEN 0 ELSE greatest(dmax, diff) END,
    CASE WHEN cut > 0 THEN (diff >= 13.3333)::INT WHEN diff >= 13.3333 THEN run + 1 ELSE 0 END,
    CASE WHEN cut > 0 THEN st END, CASE WHEN cut > 0 THEN t END, CASE WHEN cut > 0 THEN reason END, CASE WHEN cut > 0 THEN score END,
    CASE cut WHEN 1 THEN dsum WHEN 2 THEN dsum + diff END, CASE cut WHEN 1 THEN n WHEN 2 THEN n + 1 END, CASE cut WHEN 1 THEN dmax WHEN 2 THEN greatest(dmax, diff) END
  FROM (
    SELECT d.recording_id, d.seq, d.t, d.diff, st, reason, score, dsum, n, dmax, run, CASE WHEN d.diff >= 40 AND d.t - st >= 1 THEN 1 WHEN d.t - st >= 3 THEN 2 ELSE 0 END AS cut
    FROM s JOIN d ON d.recording_id = s.recording_id AND d.seq = s.seq + 1
  )
),
raw AS (
  SELECT recording_id, c_start AS start, c_end AS "end", c_reason AS reason, c_score AS score, c_sum AS diff_sum, c_n AS samples, c_max AS diff_max FROM s WHERE c_start IS NOT NULL
  UNION ALL
  SELECT recording_id, arg_max(st, seq), min(t) + floor(count(*) / 4.0::DOUBLE * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE, arg_max(reason, seq), arg_max(score, seq), arg_max(dsum, seq), arg_max(n, seq), arg_max(dmax, seq) FROM s GROUP BY recording_id
)"""


def _walk(name: str, source: str, joins: str) -> str:
    """Segments of source in order; joins (over a: last kept, b: next) says whether b goes into a."""
    return f"""
{name}_o AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY start, "end") AS rn FROM {source} WHERE "end" > start),
{name}_w AS (
  SELECT recording_id, rn, 1 AS slot, start AS st, "end" AS en, reason, score, diff_sum, samples, merged FROM {name}_o WHERE rn = 1
  UNION ALL
  SELECT a.recording_id, b.rn, CASE WHEN {joins} THEN slot ELSE slot + 1 END, CASE WHEN {joins} THEN st ELSE b.start END, CASE WHEN {joins} THEN greatest(en, b."end") ELSE b."end" END,
    CASE WHEN {joins} THEN a.reason ELSE b.reason END, CASE WHEN {joins} THEN a.score ELSE b.score END, CASE WHEN {joins} THEN a.diff_sum + b.diff_sum ELSE b.diff_sum END,
    CASE WHEN {joins} THEN a.samples + b.samples ELSE b.samples END, CASE WHEN {joins} THEN a.merged + b.merged ELSE b.merged END
  FROM {name}_w a JOIN {name}_o b ON a.recording_id = b.recording_id AND b.rn = a.rn + 1
),
{name} AS (
  SELECT recording_id, arg_max(st, rn) AS start, arg_max(en, rn) AS "end", arg_max(reason, rn) AS reason, arg_max(score, rn) AS score, arg_max(diff_sum, rn) AS diff_sum, arg_max(samples, rn) AS samples,
    arg_max(merged, rn) AS merged FROM {name}_w GROUP BY recording_id, slot
)"""


_GROWN = f"{_RAW}, one AS (SELECT *, 1::BIGINT AS merged FROM raw),{_walk('grown', 'one', 'en - st < 1')}"
_MERGED = f"{_GROWN},{_walk('kept', 'grown', '(b.\"end\" - b.start < 1 AND en - st + (b.\"end\" - b.start) <= 3)')}"
_R4 = "floor({} * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE".format
_FINAL = f"""{_MERGED},
final AS (
  SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY start)::INT AS "index", {_R4('start')} AS start, {_R4('"end"')} AS "end", {_R4('("end" - start)')} AS seconds, reason,
    {_R4('score')} AS score, CASE WHEN samples > 0 THEN {_R4('(diff_sum / samples)')} ELSE 0 END AS motion, merged, samples FROM kept
),
fin AS (SELECT *, 's' || lpad("index"::VARCHAR, greatest(3, length("index"::VARCHAR))::INT, '0') AS id FROM final)"""
_BOXES = """
b AS (
  SELECT l_orderkey AS frame_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS id,
    (l_linenumber % 2)::BIGINT AS class, floor((0.3::DOUBLE + l_quantity / 72) * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS score, (l_partkey % 4) * 6 AS x, (l_suppkey % 3) * 6 AS y, 30 + (l_partkey % 3) * 5 AS w, 30 + (l_suppkey % 5) * 4 AS h
  FROM lineitem
)"""
_LINES = f"{_BOXES}, lines AS (SELECT *, CASE WHEN class = 0 THEN score END AS confidence, CASE WHEN id % 4 = 0 THEN ' ' ELSE 'line ' || id END AS text FROM b)"
_SPEECH = """
sp0 AS (SELECT conv_id AS recording_id, turn AS item, text, greatest(5, length(text)) AS cs, ((conv_id + turn) % 4) * 20 AS gap FROM conversations),
sp1 AS (SELECT *, sum(cs + gap) OVER (PARTITION BY recording_id ORDER BY item ROWS UNBOUNDED PRECEDING) - cs AS begun FROM sp0),
sp AS (SELECT recording_id, item, begun / 100.0::DOUBLE AS s_start, (begun + cs) / 100.0::DOUBLE AS s_end, text FROM sp1),
sil AS (SELECT recording_id, start, "end" FROM (SELECT recording_id, coalesce(lag(s_end) OVER (PARTITION BY recording_id ORDER BY item), 0.0) AS start, s_start AS "end" FROM sp) WHERE "end" > start),
dur AS (SELECT recording_id, max(s_end) AS duration FROM sp GROUP BY recording_id),
grid AS (SELECT recording_id, i AS "index", (i - 1) * 4.0::DOUBLE AS start, i * 4.0::DOUBLE AS "end" FROM (SELECT recording_id, unnest(range(1, ceil(duration / 4.0)::BIGINT + 1))::INT AS i FROM dur))"""
_SAID = f"""{_SPEECH},
said AS (
  SELECT recording_id, "index", {_R4('seconds')} AS seconds, text FROM (
    SELECT g.recording_id, "index", sum(CAST(least("end", s_end) - greatest(start, s_start) AS DECIMAL(38, 12)))::DOUBLE AS seconds, string_agg({_TRIM('text')}, ' ' ORDER BY s_start, s_end) FILTER ({_TRIM('text')} <> '') AS text
    FROM grid g JOIN sp ON g.recording_id = sp.recording_id AND least("end", s_end) - greatest(start, s_start) > 0.2 GROUP BY ALL
  ) WHERE coalesce(text, '') <> ''
)"""
_TILES = """
g0 AS (SELECT vec_id AS frame_id, label::BIGINT AS recording_id, vec_id % 6 AS v, embedding FROM embeddings),
g AS (SELECT *, list_transform(range(64), lambda i: CASE WHEN v = 5 THEN 40 + 20.0 * (i % 8) ELSE least(greatest(floor((CASE WHEN v = 1 THEN 20.0 ELSE 128.0 END)::DOUBLE + embedding[i + 1]::DOUBLE * ([10, 10, 600, 90, 45, 0])[v + 1]), 0), 255) END::DOUBLE) AS p FROM g0),
px AS (SELECT frame_id, p, unnest(range(64)) AS i FROM g),
pe AS (
  SELECT frame_id, (i % 8) // 4 AS "column", i // 32 AS "row", i % 8 AS x, i // 8 AS y, p[i + 1] AS v,
    (CASE WHEN i % 8 < 7 AND abs(p[i + 1] - p[i + 2]) > 24 THEN 1 ELSE 0 END + CASE WHEN i < 56 AND abs(p[i + 1] - p[i + 9]) > 24 THEN 1 ELSE 0 END) AS edges FROM px
),
ts AS (
  SELECT frame_id, "column", "row", min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height, floor(sum(v) / count(*) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS luma,
    floor(sqrt(greatest(sum(v * v) / count(*) - (sum(v) / count(*)) * (sum(v) / count(*)), 0)) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS std, floor(sum(edges) / (2.0::DOUBLE * count(*)) * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS edge_density
  FROM pe GROUP BY ALL
),
tl AS (SELECT *, CASE WHEN std < 4 THEN CASE WHEN luma < 48 THEN 'dark' ELSE 'flat' END WHEN edge_density >= 0.09 THEN 'text' WHEN std >= 12 THEN 'picture' ELSE 'texture' END AS label FROM ts),
sh0 AS (SELECT frame_id, k, sum(CASE WHEN label = ['text', 'picture', 'texture', 'flat', 'dark'][k + 1] THEN width * height ELSE 0 END) * 10000.0::DOUBLE / sum(width * height) AS exact FROM tl, (SELECT unnest(range(5)) AS k) GROUP BY ALL),
sh1 AS (SELECT *, floor(exact) + CASE WHEN row_number() OVER (PARTITION BY frame_id ORDER BY exact - floor(exact) DESC, k) <= 10000 - sum(floor(exact)) OVER (PARTITION BY frame_id) THEN 1 ELSE 0 END AS units FROM sh0),
sh AS (SELECT frame_id, max(units / 10000.0::DOUBLE) FILTER (k = 0) AS text, max(units / 10000.0::DOUBLE) FILTER (k = 1) AS picture, max(units / 10000.0::DOUBLE) FILTER (k = 2) AS texture, max(units / 10000.0::DOUBLE) FILTER (k = 3) AS flat, max(units / 10000.0::DOUBLE) FILTER (k = 4) AS dark FROM sh1 GROUP BY frame_id)"""
_SUPPRESSED = """
      f AS (SELECT frame_id, rn, [{'id': id, 'class': class, 'score': score, 'x': x, 'y': y, 'w': w, 'h': h}] AS kept FROM o WHERE rn = 1 UNION ALL
        SELECT o.frame_id, o.rn, CASE WHEN len(kept) >= 50 OR len(list_filter(kept, lambda k: k['class'] = o.class AND least(k.x + k.w, o.x + o.w) > greatest(k.x, o.x) AND least(k.y + k.h, o.y + o.h) > greatest(k.y, o.y)
          AND (least(k.x + k.w, o.x + o.w) - greatest(k.x, o.x)) * (least(k.y + k.h, o.y + o.h) - greatest(k.y, o.y)) / (k.w * k.h + o.w * o.h - (least(k.x + k.w, o.x + o.w) - greatest(k.x, o.x)) * (least(k.y + k.h, o.y + o.h) - greatest(k.y, o.y)))::DOUBLE > 0.45)) > 0
          THEN kept ELSE list_append(kept, {'id': o.id, 'class': o.class, 'score': o.score, 'x': o.x, 'y': o.y, 'w': o.w, 'h': o.h}) END FROM f JOIN o ON o.frame_id = f.frame_id AND o.rn = f.rn + 1),
      l AS (SELECT frame_id, unnest(arg_max(kept, rn)) AS k FROM f GROUP BY 1)"""
_SUM = lambda v: f"list_reduce(list_prepend(0.0::DOUBLE, list({v} ORDER BY y, x)), lambda a, b: a + b)"
_SIZES = "z AS (SELECT p_partkey, p_partkey % 1931 + 1 AS w, p_size * 37 + p_partkey % 11 + 1 AS h FROM part)"
_EVIDENCE_OF = r"""
el AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')) AS ls FROM ev),
te AS (
  SELECT doc_id,
    regexp_matches(text, '(?m)(^|\s)(PS\s+[A-Za-z]:\\|C:\\[^ ]*>|>|\$|#)\s*$')::BIGINT + regexp_matches(text, '(^|\s)(npm|pnpm|yarn|git|node|python|pip|cargo|go|dotnet|docker|kubectl)\s+[\w-]+')::BIGINT
      + regexp_matches(text, '(?i)\b(error|warning|failed|exception|traceback|permission denied)\b')::BIGINT + regexp_matches(text, '\b(npm ERR!|ELIFECYCLE|ENOENT|EPERM)\b')::BIGINT
      + len(list_filter(ls, lambda x: regexp_matches(x, '^\s*(PS\s+[A-Za-z]:\\|C:\\[^ ]*>|\$|>|#)\s'))) AS shell_hits,
    regexp_matches(text, '(?m)[{};]\s*$')::BIGINT + regexp_matches(text, '\b(function|const|let|var|class|import|export|def|return|async|await|public|private|void)\b')::BIGINT
      + regexp_matches(text, '=>|===|!==|::|\+\+|-->')::BIGINT + regexp_matches(text, '(?m)^\s*(if|for|while|switch|try|catch)\s*[({]')::BIGINT + len(list_filter(ls, lambda x: regexp_matches(x, '[{};]\s*$|^\s{2,}\S'))) AS code_hits,
    length(text) + len(regexp_extract_all(text, '[\x{10000}-\x{10FFFF}]')) AS char_count, len(ls) AS line_count
  FROM el
)"""
_KIND_OF = """ki AS (
  SELECT *, CASE WHEN shell_hits >= 3 AND dark >= 0.15 THEN 'terminal' WHEN code_hits >= 4 AND text >= 0.08 THEN 'code' WHEN person >= 0.25 AND text < 0.1 THEN 'presenter' WHEN picture >= 0.45 THEN 'picture'
    WHEN text >= 0.16 OR line_count >= 12 THEN 'text' WHEN text + flat >= 0.6 AND line_count >= 3 THEN 'document' WHEN motion < 0.35 AND line_count = 0 AND objects = 0 THEN 'idle' ELSE 'desktop' END AS kind FROM fa
)"""
_EVIDENCE = rf"""
ev AS (
  SELECT doc_id, CASE WHEN doc_id % 5 IN (1, 3) THEN '$ npm run build' || chr(10) || 'error: failed' || chr(10) || '> git status' || chr(10) || '# done' || chr(10)
    WHEN doc_id % 5 = 2 THEN 'function a() {{' || chr(10) || '  return b === c;' || chr(10) || '}}' || chr(10) || 'const x = () => y;' || chr(10) ELSE '' END || text AS text FROM documents
), {_EVIDENCE_OF}, fa AS (
  SELECT doc_id, shell_hits, code_hits, line_count, doc_id * 3 % 11 / 11.0::DOUBLE AS text, doc_id * 5 % 13 / 13.0::DOUBLE AS picture, doc_id * 7 % 17 / 17.0::DOUBLE AS flat, doc_id * 2 % 7 / 7.0::DOUBLE AS dark, doc_id * 11 % 19 / 19.0::DOUBLE AS person,
    doc_id % 3 AS objects, doc_id * 13 % 23 / 23.0::DOUBLE AS motion FROM te
), {_KIND_OF}"""
_pct = lambda x: f"format('{{:.1f}}%', floor(({x}) * 1000 + 0.5) / 10)"

_CONFIGS = "WITH k AS (SELECT p_partkey, p_size, p_partkey % 17 > 1 AS given FROM part)"
_blocks = lambda n: f"""lab AS (SELECT frame_id, list(label ORDER BY "row", "column") AS l FROM tl GROUP BY 1),
      walk AS (
        SELECT frame_id, l, 0 AS k, 0::BIGINT AS taken, 0 AS w, 0 AS h FROM lab
        UNION ALL
        SELECT frame_id, l, k + 1, CASE WHEN w = 0 THEN taken ELSE taken | list_sum(list_transform(range(w * h), lambda c: 1::BIGINT << (k + c % w + {n} * (c // w))))::BIGINT END, w, h
        FROM (
          SELECT *, CASE WHEN w = 0 THEN 0 ELSE coalesce(list_min(list_filter(range(1, {n} - k // {n}), lambda j: len(list_filter(range(w), lambda c: l[k + {n} * j + c + 1] <> l[k + 1] OR taken >> (k + {n} * j + c) & 1 = 1)) > 0)), {n} - k // {n}) END::INT AS h
          FROM (SELECT frame_id, l, k, taken, CASE WHEN taken >> k & 1 = 1 THEN 0 ELSE coalesce(list_min(list_filter(range(1, {n} - k % {n}), lambda j: l[k + j + 1] <> l[k + 1] OR taken >> (k + j) & 1 = 1)), {n} - k % {n}) END::INT AS w FROM walk WHERE k < {n * n})
        )
      )"""  # noqa: E731
_REASON = f"""CASE kind WHEN 'terminal' THEN shell_hits || ' lines like shell output, dark share ' || {_pct('dark')} WHEN 'code' THEN code_hits || ' lines like code, text share ' || {_pct('text')}
      WHEN 'presenter' THEN 'a person is seen, text share ' || {_pct('text')} WHEN 'picture' THEN 'picture share ' || {_pct('picture')} WHEN 'text' THEN 'text share ' || {_pct('text')} || ', lines ' || line_count
      WHEN 'document' THEN 'text and flat share ' || {_pct('least(text + flat, 99)')} || ', lines ' || line_count WHEN 'idle' THEN 'little motion, no text, no objects' ELSE 'no rule holds, lines ' || line_count END"""
_KEYWORD = r"""regexp_replace(lower(unnest(regexp_extract_all(line, '[A-Za-z][A-Za-z0-9_+#.-]+'))), '[.-]+$', '')"""
_STOPS = "('the','and','for','with','that','this','from','are','was','were','have','has','had','not','but','you','your','our','its','it','is','be','to','of','in','on','at','as','by','or','an','a','if','then','else','when','will','can','may','all','any','one','two','new','use','used','using','get','set','out','http','https','www','com','true','false','null','undefined')"
_PLACE = "translate(term, '_-.#+', chr(1) || chr(2) || chr(3) || chr(4) || chr(5))"
_SHARES = ("text", "picture", "texture", "flat", "dark")
_PARTS = f"""{_FINAL}, {_TILES}, {_BOXES}, {_SPEECH}, {_blocks(2)},
still AS (SELECT recording_id, "index", floor((start + "end") / 2 * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE AS "at", recording_id * 7 + "index" AS still FROM fin WHERE "index" <= 6 AND recording_id * 7 + "index" IN (SELECT vec_id FROM embeddings)),
recs AS (SELECT DISTINCT recording_id FROM fin),
spk AS (SELECT recording_id, s_start + CASE WHEN recording_id % 9 = 5 THEN 10000 ELSE 0 END AS s_start, s_end + CASE WHEN recording_id % 9 = 5 THEN 10000 ELSE 0 END AS s_end, text FROM sp WHERE recording_id % 4 <> 2),
stat AS (SELECT recording_id, 'text' AS section, 'the reader is off' AS reason FROM recs WHERE recording_id % 7 = 3 UNION ALL SELECT recording_id, 'objects', 'no model' FROM recs WHERE recording_id % 5 = 4
  UNION ALL SELECT recording_id, 'speech', 'no audio' FROM recs WHERE recording_id NOT IN (SELECT recording_id FROM spk)),
fail AS (SELECT recording_id, "index", 'regions' AS section, 'no pixels' AS message FROM still WHERE still % 11 = 0 UNION ALL SELECT recording_id, "index", 'objects', 'out of memory' FROM still WHERE still % 13 = 5 AND recording_id % 5 <> 4),
region AS (SELECT still.recording_id, "index", sh.*, nb.blocks FROM still JOIN sh ON frame_id = still JOIN (SELECT frame_id AS f, count(*)::INT AS blocks FROM walk WHERE w > 0 GROUP BY 1) nb ON f = still WHERE still % 11 <> 0),
ln AS (SELECT recording_id, "index", still, pos, line FROM (SELECT recording_id, "index", still, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM still JOIN documents ON doc_id = still WHERE "index" <= 5 AND recording_id % 7 <> 3) WHERE {_TRIM('line')} <> ''),
tx AS (SELECT recording_id, "index", coalesce(t, '') AS text, coalesce(n, 0)::INT AS n FROM still LEFT JOIN (SELECT recording_id, "index", string_agg(line, chr(10) ORDER BY pos) AS t, count(*) AS n FROM ln GROUP BY ALL) USING (recording_id, "index") WHERE "index" <= 5 AND recording_id % 7 <> 3),
o AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, id) AS rn FROM b), {_SUPPRESSED},
counted AS (SELECT recording_id, count(*) AS n FROM fin GROUP BY 1), sampled AS (SELECT DISTINCT recording_id, floor(i * (n - 1) / 3.0::DOUBLE + 0.5)::BIGINT + 1 AS k FROM counted, (SELECT unnest(range(4)) AS i)),
ob AS (
  SELECT s.recording_id, s."index", CASE k['class'] WHEN 1 THEN 'person' ELSE 'TV' END AS label, k.score AS score FROM still s JOIN l ON l.frame_id = s.still JOIN counted n ON n.recording_id = s.recording_id
  LEFT JOIN (SELECT recording_id, min("index") AS stop FROM fail WHERE section = 'objects' GROUP BY 1) f ON f.recording_id = s.recording_id
  WHERE s.recording_id % 5 <> 4 AND (stop IS NULL OR s."index" < stop) AND (n.n <= 4 OR (s.recording_id, s."index") IN (SELECT (recording_id, k) FROM sampled))
), oc AS (SELECT recording_id, "index", count(*)::INT AS n, max(CASE WHEN label = 'person' THEN score ELSE 0 END) AS person FROM ob GROUP BY ALL),
sd AS (
  SELECT f.recording_id, f."index", sum(CAST(least(f."end", s_end) - greatest(f.start, s_start) AS DECIMAL(38, 12)))::DOUBLE AS seconds, string_agg({_TRIM('text')}, ' ' ORDER BY s_start, s_end) FILTER ({_TRIM('text')} <> '') AS said
  FROM fin f JOIN spk ON f.recording_id = spk.recording_id AND least(f."end", s_end) - greatest(f.start, s_start) > 0.2 GROUP BY ALL
), ev AS (SELECT f.recording_id * 1000000 + f."index" AS doc_id, coalesce(text, '') AS text FROM fin f LEFT JOIN tx USING (recording_id, "index")), {_EVIDENCE_OF},
fa AS (
  SELECT te.doc_id, f.recording_id, f."index", shell_hits, code_hits, line_count, coalesce(r.text, 0) AS text, coalesce(picture, 0) AS picture, coalesce(texture, 0) AS texture, coalesce(flat, 0) AS flat, coalesce(dark, 0) AS dark, coalesce(person, 0) AS person, coalesce(oc.n, 0) AS objects, motion
  FROM fin f JOIN te ON te.doc_id = f.recording_id * 1000000 + f."index" LEFT JOIN region r ON r.recording_id = f.recording_id AND r."index" = f."index" LEFT JOIN oc ON oc.recording_id = f.recording_id AND oc."index" = f."index"
), {_KIND_OF}, whys AS (SELECT *, {_REASON} AS kind_reason FROM ki)"""

SQL = {
    "frame_diffs": f"WITH {_DIFFS} SELECT * FROM d",
    "luma_diff": f"""WITH o AS (SELECT label::BIGINT AS recording_id, vec_id AS seq, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM embeddings)
      SELECT recording_id, seq, CASE WHEN before IS NULL THEN 0 ELSE {_R4('(list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(1, 65), lambda i: abs(before[i]::DOUBLE - embedding[i]::DOUBLE))), lambda a, b: a + b) / 64)')} END AS diff FROM o""",
    "segments_raw": f"WITH RECURSIVE {_RAW} SELECT * FROM raw",
    "segments_grown": f"WITH RECURSIVE {_GROWN} SELECT * FROM grown",
    "segments_merged": f"WITH RECURSIVE {_MERGED} SELECT * FROM kept",
    "segments_capped": f"""WITH RECURSIVE {_MERGED}, r AS (SELECT *, least(row_number() OVER (PARTITION BY recording_id ORDER BY start), 5) AS slot FROM kept)
      SELECT recording_id, min(start) AS start, max("end") AS "end", arg_min(reason, start) AS reason, arg_min(score, start) AS score, sum(diff_sum ORDER BY start) AS diff_sum, sum(samples)::BIGINT AS samples, sum(merged)::BIGINT AS merged FROM r GROUP BY recording_id, slot""",
    "segments_final": f"WITH RECURSIVE {_FINAL} SELECT * FROM fin",
    "keyframe_plan": f"""WITH RECURSIVE {_FINAL} SELECT recording_id, "index", id, floor((start + "end") / 2 * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE AS "at" FROM fin WHERE "index" <= 3""",
    "keyframe_left_join": f"""WITH RECURSIVE {_FINAL} SELECT recording_id, "index", id, CASE WHEN "index" <= 3 THEN floor((start + "end") / 2 * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE END AS "at" FROM fin""",
    "spread_sample": f"""WITH RECURSIVE {_FINAL}, n AS (SELECT recording_id, count(*) AS n FROM fin GROUP BY 1),
      p AS (SELECT DISTINCT recording_id, floor(i * (n - 1) / 3.0::DOUBLE + 0.5)::BIGINT + 1 AS k FROM n, (SELECT unnest(range(4)) AS i)) SELECT recording_id, "index", start FROM fin JOIN n USING (recording_id) WHERE n <= 4 OR (recording_id, "index") IN (SELECT (recording_id, k) FROM p)""",
    "head_limit": f"""WITH RECURSIVE {_FINAL} SELECT recording_id, "index", start FROM fin WHERE "index" <= 2""",
    "chapters": f"""WITH RECURSIVE {_FINAL} SELECT recording_id, ';FFMETADATA1' || chr(10) || '# a chapter for each segment' || chr(10) || string_agg('[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || floor(start * 1000 + 0.5)::BIGINT || chr(10) || 'END=' || floor("end" * 1000 + 0.5)::BIGINT || chr(10) || 'title=' || id || ' ' || reason || ' ' || printf('%.2fs-%.2fs', start, "end") || chr(10), '' ORDER BY "index") AS chapters FROM fin GROUP BY 1""",
    "tile_stats": f"WITH {_TILES} SELECT *, 0.0::DOUBLE AS saturation FROM tl",
    "tile_label": f"WITH {_TILES} SELECT label, count(*) AS n FROM tl GROUP BY 1",
    "area_shares": f"WITH {_TILES} SELECT * FROM sh",
    "mean_shares": f"WITH {_TILES} SELECT recording_id, {', '.join(_R4(f'avg({k})') + f' AS {k}' for k in ('text', 'picture', 'texture', 'flat', 'dark'))} FROM sh JOIN g USING (frame_id) GROUP BY 1",
    "iou_pairs": f"""WITH {_BOXES}, p AS (SELECT a.frame_id, a.class, a.id AS id1, c.id AS id2, greatest(least(a.x + a.w, c.x + c.w) - greatest(a.x, c.x), 0) * greatest(least(a.y + a.h, c.y + c.h) - greatest(a.y, c.y), 0) AS i, a.w * a.h + c.w * c.h AS u
      FROM b a JOIN b c ON a.frame_id = c.frame_id AND a.class = c.class AND a.id < c.id) SELECT frame_id, class, id1, id2, {_R4('(i / (u - i)::DOUBLE)')} AS iou FROM p WHERE i > 0""",
    "nms": f"""WITH RECURSIVE {_BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, id) AS rn FROM b), {_SUPPRESSED} SELECT frame_id, k.id AS id, k['class'] AS class, k.score AS score FROM l""",
    "object_counts": f"""WITH {_BOXES}, c AS (SELECT frame_id, CASE class WHEN 1 THEN 'person' ELSE 'TV' END AS label, count(*) AS n FROM b GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY n DESC, lower(label)) AS rank FROM c""",
    "person_score": f"WITH {_BOXES} SELECT frame_id, coalesce(max(score) FILTER (class = 1), 0) AS person FROM b GROUP BY 1",
    "score_filter": f"WITH {_BOXES} SELECT frame_id, count(*) AS kept, max(score) AS best FROM b WHERE score >= 0.5 GROUP BY 1",
    "speech_intervals": f"""WITH {_SPEECH}, e AS (SELECT recording_id, start, "end" FROM sil UNION ALL SELECT recording_id, duration, duration FROM dur),
      ga AS (SELECT recording_id, coalesce(max("end") OVER (PARTITION BY recording_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS f, start AS t FROM e),
      gp AS (SELECT *, greatest(ceil((t - f) / 10.0) - 1, 0)::INT AS n FROM ga WHERE t > f), c AS (SELECT f, t, n, recording_id, unnest(range(n + 1)) AS i FROM gp),
      q AS (SELECT recording_id, f + i * 10.0::DOUBLE AS a, CASE WHEN i < n THEN f + i * 10.0::DOUBLE + 10.0::DOUBLE ELSE t END AS z FROM c WHERE i < n OR t - (f + i * 10.0::DOUBLE) >= 0.25)
      SELECT recording_id, {_R4('a')} AS start, {_R4('z')} AS "end", {_R4('(z - a)')} AS seconds FROM q""",
    "parse_silences": f"WITH {_SPEECH} SELECT * FROM sil",
    "plan_cuts": f"""WITH RECURSIVE {_SPEECH}, st AS (SELECT recording_id, list(start) AS starts FROM sil GROUP BY 1), base AS (SELECT dur.recording_id, duration, coalesce(starts, []) AS starts FROM dur LEFT JOIN st USING (recording_id)),
      w AS (SELECT recording_id, duration, starts, 0.0::DOUBLE AS pos, NULL::BOOLEAN AS forced FROM base UNION ALL SELECT recording_id, duration, starts, coalesce(m, pos + 8), m IS NULL FROM
        (SELECT *, list_max(list_filter(starts, lambda x: x > pos + 2 AND x <= pos + 8 AND x >= pos + 2)) AS m FROM w WHERE duration - pos > 8)) SELECT recording_id, pos AS cut, forced FROM w WHERE forced IS NOT NULL""",
    "merge_intervals": f"""WITH RECURSIVE {_SPEECH}, si AS (SELECT recording_id, list({{'s': start, 'e': "end", 'n': "end" - start, 'm': 1::BIGINT}} ORDER BY start) AS l FROM (@SPEECH_INTERVALS@) WHERE "end" - start > 0.01 GROUP BY 1),
      w AS (
        SELECT recording_id, l, 0 AS step FROM si
        UNION ALL
        SELECT recording_id, list_concat(list_append(l[: i - 1], {{'s': l[i].s, 'e': l[i + 1].e, 'n': l[i + 1].e - l[i].s, 'm': l[i].m + l[i + 1].m}}), l[i + 2 :]), step + 1
        FROM (SELECT *, list_position(costs, list_min(costs)) AS i FROM (SELECT *, list_transform(range(1, len(l)), lambda j: l[j + 1].s - l[j].e + (l[j].n + l[j + 1].n) * 0.01::DOUBLE) AS costs FROM w WHERE len(l) > 4)) WHERE l[i + 1].e - l[i].s <= 20
      ), f AS (SELECT recording_id, unnest(arg_max(l, step)) AS p FROM w GROUP BY 1)
      SELECT recording_id, {_R4('p.s')} AS start, {_R4('p.e')} AS "end", {_R4('p.n')} AS seconds, p.m AS merged FROM f""",
    "speech_overlap": f"WITH {_SAID} SELECT * FROM said",
    "assign_segments": f"""WITH {_SPEECH}, g AS (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY start) AS "index", start, "end" FROM (@SPEECH_INTERVALS@)), m AS (SELECT *, (s_start + s_end) / 2 AS mid FROM sp), l AS (SELECT recording_id, arg_max("index", "end") AS last, max("end") AS fin FROM g GROUP BY 1)
      SELECT m.recording_id, item, mid, coalesce(min(g."index"), any_value(CASE WHEN mid >= fin THEN last END)) AS "index" FROM m LEFT JOIN g ON g.recording_id = m.recording_id AND mid >= g.start AND mid < g."end" LEFT JOIN l ON l.recording_id = m.recording_id GROUP BY ALL""",
    "assign_unplaced": f"""WITH {_SPEECH}, g AS (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY start) AS "index", start, "end" FROM (@SPEECH_INTERVALS@)), m AS (SELECT *, (s_start + s_end) / 2 AS mid FROM sp)
      SELECT recording_id, item FROM m WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.recording_id = m.recording_id AND mid >= g.start AND mid < g."end") AND NOT coalesce(mid >= (SELECT max("end") FROM g WHERE g.recording_id = m.recording_id), false)""",
    "transcript_text": f"WITH {_SPEECH} SELECT recording_id, string_agg(text, chr(10) ORDER BY s_start, s_end) AS transcript, count(*) AS spoken FROM sp WHERE {_TRIM('text')} <> '' GROUP BY 1",
    "text_evidence": f"WITH {_EVIDENCE} SELECT doc_id, shell_hits, code_hits, char_count, line_count FROM te",
    "segment_kind": f"WITH {_EVIDENCE} SELECT doc_id, kind FROM ki",
    "kind_reason": f"""WITH {_EVIDENCE} SELECT doc_id, kind, {_REASON} AS reason FROM ki""",
    "group_kinds": f"WITH {_EVIDENCE} SELECT doc_id % 20 AS recording_id, kind, string_agg((doc_id // 20)::VARCHAR, ',' ORDER BY doc_id // 20) AS indexes FROM ki GROUP BY ALL",
    "keywords": """WITH w AS (SELECT regexp_replace(lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_+#.-]+'))), '[.-]+$', '') AS term FROM documents)
      SELECT term, count(*) AS n FROM w WHERE length(term) >= 2 AND term NOT IN ('the','and','for','with','that','this','from','are','was','were','have','has','had','not','but','you','your','our','its','it','is','be','to','of','in','on','at','as','by','or','an','a','if','then','else','when','will','can','may','all','any','one','two','new','use','used','using','get','set','out','http','https','www','com','true','false','null','undefined') GROUP BY 1""",
    "region_filter": f"WITH {_LINES} SELECT frame_id, id FROM lines WHERE x + w >= 12 AND x <= 32 AND y + h >= 6 AND y <= 9",
    "confidence_filter": f"WITH {_LINES} SELECT frame_id, id FROM lines WHERE (confidence IS NULL OR confidence >= 0.6) AND {_TRIM('text')} <> ''",
    "map_lines": f"""WITH {_LINES}, m AS (SELECT frame_id, id, floor(x * 0.75::DOUBLE - 20 + 0.5)::BIGINT AS x, floor(y * 0.75::DOUBLE + 3 + 0.5)::BIGINT AS y, floor(w * 0.75::DOUBLE + 0.5)::BIGINT AS w, floor(h * 0.75::DOUBLE + 0.5)::BIGINT AS h FROM lines)
      SELECT m.*, floor(m.x + m.w / 2.0::DOUBLE + 0.5)::BIGINT AS cx, floor(m.y + m.h / 2.0::DOUBLE + 0.5)::BIGINT AS cy,
        (SELECT concat_ws(' ', a, b, c, b, c, e) FROM (SELECT floor(l.x * 0.75::DOUBLE - 20 + 0.5)::BIGINT AS a, floor(l.y * 0.75::DOUBLE + 3 + 0.5)::BIGINT AS b, floor((l.x + l.w) * 0.75::DOUBLE - 20 + 0.5)::BIGINT AS c, floor((l.y + l.h) * 0.75::DOUBLE + 3 + 0.5)::BIGINT AS e)) AS polygon
        FROM m JOIN (SELECT frame_id, id, x, y, w, h FROM lines) l USING (frame_id, id)""",
    "line_confidence": f"""WITH {_LINES} SELECT frame_id, id, CASE WHEN class = 0 THEN score WHEN id % 5 <> 0 THEN {_R4('least(greatest(score * 1.7::DOUBLE - 0.6::DOUBLE, 0), 1)')} END AS confidence FROM lines""",
    "valid_segments": f"""WITH RECURSIVE {_RAW} SELECT * REPLACE (CASE WHEN score > 60 THEN 0 ELSE score END AS score) FROM raw WHERE "end" > start""",
    "reading_order": f"WITH {_LINES} SELECT frame_id, string_agg(id::VARCHAR, ',' ORDER BY y, x, id) AS ids FROM lines GROUP BY 1",
    "polygon_bbox": f"WITH {_LINES} SELECT frame_id, id, least(x, x + w, x + 2) AS x, least(y + 1, y, y + h) AS y, greatest(x, x + w, x + 2) - least(x, x + w, x + 2) AS w, greatest(y + 1, y, y + h) - least(y + 1, y, y + h) AS h FROM lines",
    "fit_inside": f"WITH {_SIZES}, r AS (SELECT *, CASE WHEN greatest(w, h) > 320 THEN 320.0::DOUBLE / greatest(w, h) ELSE 1 END AS f FROM z) SELECT p_partkey, greatest(floor(w * f / 2 + 0.5)::BIGINT * 2, 2) AS width, greatest(floor(h * f / 2 + 0.5)::BIGINT * 2, 2) AS height, greatest(w, h) > 320 AS scaled FROM r",
    "analysis_size": f"WITH {_SIZES}, r AS (SELECT *, least(1.0, 320.0::DOUBLE / greatest(w, h)) AS f FROM z) SELECT p_partkey, greatest(floor(w * f + 0.5)::BIGINT // 2 * 2, 2) AS width, greatest(floor(h * f + 0.5)::BIGINT // 2 * 2, 2) AS height FROM r",
    "letterbox": f"WITH {_SIZES} SELECT p_partkey, greatest(floor((640 - w) / 2.0)::BIGINT, 0) AS pad_x, greatest(floor((640 - h) / 2.0)::BIGINT, 0) AS pad_y FROM z",
    "ocr_scale": f"WITH {_SIZES} SELECT p_partkey, least(greatest(floor(1000.0::DOUBLE / greatest(w, h) + 0.5)::BIGINT, 1), 3) AS scale FROM z",
    "half_decode": """WITH h AS (SELECT p_partkey, p_partkey * 7919 % 31744 AS m, CASE WHEN p_size % 2 = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS s FROM part)
      SELECT p_partkey, CASE WHEN m < 1024 THEN s * m * pow(2.0::DOUBLE, -24) ELSE s * pow(2.0::DOUBLE, m // 1024 - 15) * (1 + m % 1024 / 1024.0::DOUBLE) END + 0.0 AS value FROM h""",
    "parse_rate": """SELECT p_partkey, floor(CASE p_partkey % 6 WHEN 0 THEN 30000.0::DOUBLE / 1001 WHEN 3 THEN p_size::DOUBLE WHEN 4 THEN 25.0::DOUBLE WHEN 5 THEN 24000.0::DOUBLE / (p_size + 990) END * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE AS rate FROM part""",
    "rotation": "SELECT p_partkey, (CASE p_size % 3 WHEN 0 THEN p_size * 90 WHEN 1 THEN 900 - p_size * 90 + 360000 ELSE 0 END % 360)::BIGINT AS degrees FROM part",
    "rate_check": "SELECT p_partkey, CASE WHEN p_size % 10 <> 0 THEN abs(p_size::DOUBLE - (p_size + (p_partkey % 5) * 0.1::DOUBLE)) < greatest(0.01::DOUBLE, p_size::DOUBLE * 0.01::DOUBLE) END AS constant FROM part",
    "language_tag": "SELECT p_partkey, (['zh-Hans-CN', 'en-US', 'ja-JP', 'fr-FR', 'zh-Hans-CN', 'zh-Hans-CN', 'zh-Hant-TW', 'de'])[p_partkey % 8 + 1] AS tag FROM part",
    "container_for": "SELECT p_partkey, (['mp4', 'mp4', 'mov', 'mkv', 'wav', NULL, NULL, NULL])[p_partkey % 8 + 1] AS container FROM part",
    "escape_value": r"""SELECT p_partkey, 'C\:\\' || replace(replace(replace(p_name, '\', '\\'), ':', '\:'), '''', '\''') || '\''s' AS escaped FROM part""",
    "tail_lines": f"SELECT doc_id, array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: {_TRIM('x')} <> '')[-2:], lambda x: regexp_replace(x, '{_BLANK}+$', '')), chr(10)) AS tail FROM documents",
    "last_json_line": "SELECT event_id, props AS json FROM events",
    "tensor_layout": """WITH q AS (SELECT p_partkey, p_partkey % 40 AS a, p_size * 30 AS b FROM part) SELECT p_partkey, CASE WHEN a BETWEEN 5 AND 1024 AND b BETWEEN 5 AND 1024 THEN CASE WHEN a < b THEN 'channel_major' ELSE 'row_major' END
      WHEN a BETWEEN 5 AND 1024 THEN 'channel_major' WHEN b BETWEEN 5 AND 1024 THEN 'row_major' END AS layout FROM q""",
    "probe_facts": """WITH p AS (
        SELECT *, p_partkey % 17 <> 0 AS ok, p_partkey % 17 <> 0 AND p_partkey % 13 <> 0 AS has, CASE p_partkey % 4 WHEN 1 THEN 90 WHEN 2 THEN 270 ELSE 0 END AS deg,
          CASE WHEN p_partkey % 7 <> 0 THEN p_size * 10.0::DOUBLE END AS w, CASE WHEN p_partkey % 11 <> 0 THEN CASE WHEN p_partkey % 19 = 0 THEN 0 ELSE p_retailprice::DOUBLE END END AS dur FROM part
      ) SELECT p_partkey, ok AS readable, CASE WHEN ok THEN 'mov' END AS container, CASE WHEN ok THEN dur END AS duration, CASE WHEN has THEN 'h264' END AS video_codec,
        CASE WHEN has THEN CASE WHEN deg > 0 THEN 100.0::DOUBLE ELSE w END END AS width, CASE WHEN has THEN CASE WHEN deg > 0 THEN w ELSE 100.0::DOUBLE END END AS height, CASE WHEN has THEN w END AS coded_width,
        CASE WHEN has THEN deg END AS rotation, CASE WHEN has THEN CASE WHEN p_partkey % 5 = 0 AND p_partkey % 3 <> 0 THEN 25.0::DOUBLE ELSE 30.0::DOUBLE END END AS rate, CASE WHEN has THEN 30.0::DOUBLE END AS real_rate,
        CASE WHEN has AND p_partkey % 3 <> 0 THEN p_partkey % 5 <> 0 END AS constant, CASE WHEN has THEN dur END AS video_seconds,
        CASE WHEN has AND p_partkey % 2 = 0 THEN 'aac' END AS audio_codec, CASE WHEN has AND p_partkey % 2 = 0 THEN 48000.0::DOUBLE END AS sample_rate, CASE WHEN has AND p_partkey % 2 = 0 THEN 2.0::DOUBLE END AS channels,
        CASE WHEN NOT ok THEN 'unreadable' ELSE concat_ws(';', CASE WHEN NOT has THEN 'no streams' END, CASE WHEN dur IS NULL THEN 'duration not told' WHEN dur <= 0 THEN 'duration not above 0' END,
          CASE WHEN has AND p_partkey % 3 <> 0 AND p_partkey % 5 = 0 THEN 'rate not constant' END, CASE WHEN has AND w IS NULL THEN 'size not told' END) END AS problems FROM p""",
    "tile_stats_color": f"""WITH {_TILES},
      cx AS (SELECT frame_id, i % 8 AS x, i // 8 AS y, p[i + 1] AS r, p[64 - i] AS g, p[(i + 8) % 64 + 1] AS b FROM (SELECT frame_id, p, unnest(range(64)) AS i FROM g)),
      cl AS (SELECT *, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS v, CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0 END AS s FROM cx),
      ce AS (SELECT *, coalesce(abs(lead(v) OVER (PARTITION BY frame_id, y ORDER BY x) - v) > 24, false)::INT + coalesce(abs(lead(v) OVER (PARTITION BY frame_id, x ORDER BY y) - v) > 24, false)::INT AS e FROM cl),
      cs AS (SELECT frame_id, least(x // 3, 1) AS "column", least(y // 3, 1) AS "row", min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height, count(*)::DOUBLE AS n, sum(e) AS e,
        {_SUM('v')} AS v, {_SUM('v * v')} AS vv, {_SUM('s')} AS s FROM ce GROUP BY frame_id, least(x // 3, 1), least(y // 3, 1)),
      ct AS (SELECT frame_id, "column", "row", x, y, width, height, floor(v / n * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS luma, floor(sqrt(greatest(vv / n - (v / n) * (v / n), 0)) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS std,
        floor(e / (2 * n) * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS edge_density, floor(s / n * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS saturation FROM cs)
      SELECT *, CASE WHEN std < 4 THEN CASE WHEN luma < 48 THEN 'dark' ELSE 'flat' END WHEN edge_density >= 0.09 AND saturation <= 0.22 THEN 'text' WHEN saturation >= 0.18 THEN 'picture' WHEN std >= 12 AND edge_density < 0.09 THEN 'picture' ELSE 'texture' END AS label FROM ct""",
    "tile_blocks": f"""WITH RECURSIVE {_TILES.replace("(i % 8) // 4", "(i % 8) // 2").replace("i // 32", "i // 16")},
      {_blocks(4)} SELECT frame_id, l[k] AS label, (k - 1) % 4 * 2::BIGINT AS x, (k - 1) // 4 * 2::BIGINT AS y, w * 2::BIGINT AS width, h * 2::BIGINT AS height, w * h::BIGINT AS tiles, floor(w * h * 4 / 64.0::DOUBLE * 10000 + 0.5) / 10000 AS area_ratio FROM walk WHERE w > 0""",
    "parse_devices": """SELECT s_nationkey AS log_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS no, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'video' ELSE 'audio' END AS kind,
      CASE WHEN s_suppkey % 3 = 0 THEN '@device_' || s_suppkey END AS alternative FROM supplier""",
    "wav_header": """WITH w AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n, CASE WHEN doc_id % 10 = 9 THEN 'no data chunk' WHEN strlen(coalesce(text, '')) = 0 THEN 'no data' END AS problem FROM documents)
      SELECT doc_id, CASE WHEN problem IS NULL THEN 32 END AS data_offset, CASE WHEN problem IS NULL THEN n END AS data_bytes, problem,
        CASE WHEN problem IS NULL THEN printf('%02X%02X%02X%02X', (n + 24) % 256, (n + 24) // 256 % 256, (n + 24) // 65536 % 256, (n + 24) // 16777216) END AS riff_size,
        CASE WHEN problem IS NULL THEN printf('%02X%02X%02X%02X', n % 256, n // 256 % 256, n // 65536 % 256, n // 16777216) END AS data_size FROM w""",
    "half_encode": """SELECT p_partkey, (CASE WHEN (p_partkey * 7919) % 31744 < 1024 THEN 0 ELSE (p_partkey * 7919) % 31744 END + CASE WHEN p_size % 2 = 0 THEN 32768 ELSE 0 END)::INT AS bits FROM part""",
    "input_tensor": f"""WITH {_TILES}, ip AS (SELECT frame_id, c, y, x, (p[CASE c WHEN 0 THEN y * 8 + x WHEN 1 THEN 63 - y * 8 - x ELSE (y * 8 + x + 8) % 64 END + 1] / 255)::FLOAT::DOUBLE AS value FROM g, range(3) a(c), range(8) b(y), range(8) e(x))
      SELECT frame_id, (c * 144 + (y + 2) * 12 + x + 2)::INT AS i, value FROM ip WHERE value > 0""",
    "scale_factor": """WITH z AS (SELECT p_partkey, (p_partkey % 1931 + 1)::DOUBLE AS w, (p_size * 37 + p_partkey % 11 + 1) % 5 AS h FROM part) SELECT p_partkey, CASE WHEN h > 0 THEN w / h ELSE 1.0::DOUBLE END AS factor FROM z""",
    "merged_options": """SELECT p_partkey, concat_ws(' ', 'codec=h264', 'crf=' || CASE WHEN p_partkey % 5 <> 0 AND p_size % 3 = 1 THEN p_size::VARCHAR ELSE '23' END, CASE WHEN p_partkey % 5 <> 0 AND p_size % 2 = 1 THEN 'fps=1' END, 'preset=fast') AS options FROM part""",
    "clamped_numbers": """SELECT p_partkey, n AS number, greatest(10, n) AS clamped FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 2 THEN p_size::DOUBLE WHEN 3 THEN -(p_size + 0.5::DOUBLE) ELSE 7 END AS n FROM part)""",
    "resolve_setting": """SELECT p_partkey, CASE WHEN p_size % 3 = 1 THEN p_retailprice::DOUBLE WHEN p_partkey % 2 = 0 THEN p_size::DOUBLE ELSE 4.0::DOUBLE END AS value FROM part""",
    "parse_region": """SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN greatest(p_size - 10, 0)::BIGINT END AS x, CASE WHEN p_partkey % 9 <> 0 THEN (p_partkey % 7)::BIGINT END AS y,
      CASE WHEN p_partkey % 9 <> 0 THEN (p_size + 1)::BIGINT END AS width, CASE WHEN p_partkey % 9 <> 0 THEN 4::BIGINT END AS height FROM part""",
    "analysis_notes": """WITH a AS (SELECT p_partkey, p_size % 5 AS frames, p_partkey % 3 AS rest, p_size AS found, (p_partkey % 4) / 2.0::DOUBLE AS st, (p_size % 5) / 4.0::DOUBLE AS sec FROM part)
      SELECT p_partkey, concat_ws('; ', CASE WHEN frames = 0 THEN 'no frames decoded' END, CASE WHEN rest > 0 THEN rest || ' bytes of a last part frame left out' END,
        CASE WHEN found > 30 THEN found || ' segments beyond the 30 allowed, the last ones put together' END, CASE WHEN st > 0 THEN 'from second ' || st || ': ' || frames || ' frames, ' || sec || ' seconds' END,
        CASE WHEN frames > 0 AND sec < 1 AND NOT (rest > 0 AND found > 30 AND st > 0 AND frames = 0) THEN sec || ' seconds are less than a segment''s least of 1.0' END) AS notes FROM a""",
    "attach_lines": f"""WITH {_LINES} SELECT frame_id AS still, id, 's' || CASE WHEN o_custkey < 1000 THEN lpad(o_custkey::VARCHAR, 3, '0') ELSE o_custkey::VARCHAR END AS segment_id, o_orderkey / 4.0::DOUBLE AS at FROM lines JOIN orders ON o_orderkey = frame_id""",
    "lossless_json": """SELECT event_id, '{"v":' || CASE event_id % 4 WHEN 2 THEN '0.0' WHEN 3 THEN floor(value)::DOUBLE::VARCHAR ELSE 'null' END || ',"t":"' || event_type || '"}' AS json FROM events""",
    "frame_split": """WITH b AS (SELECT conv_id AS stream_id, hex(encode(string_agg(coalesce(text, ''), '' ORDER BY turn))) AS b FROM conversations GROUP BY 1)
      SELECT stream_id, i, sha256(unhex(b[i * 128 + 1 : i * 128 + 128])) AS frame FROM (SELECT stream_id, b, unnest(range(length(b) // 128)) AS i FROM b)""",
    "capture_verdict": """WITH o AS (
        SELECT o_orderkey, o_totalprice / 1000 AS asked, o_totalprice / 1000 * (0.8::DOUBLE + (o_orderkey % 26) / 100.0::DOUBLE) AS d, 0.85::DOUBLE + (o_custkey % 16) / 100.0::DOUBLE AS kept,
          o_custkey % 2 = 0 AS audio_asked, o_custkey % 3 <> 0 AS audio, o_orderkey % 29 <> 0 AS readable, CASE WHEN o_custkey % 23 = 0 THEN 0 ELSE 1 END AS whole FROM orders
      ), c AS (
        SELECT *, CASE WHEN o_orderkey % 17 <> 0 THEN d END AS dur, CASE WHEN o_orderkey % 19 <> 0 THEN floor(floor(d * 30 + 0.5) * kept * whole) END AS frames FROM o
      ), v AS (
        SELECT *, CASE WHEN readable THEN dur < 0.9::DOUBLE * asked END AS short_take, coalesce(readable AND floor(dur * 30 + 0.5) > 0 AND frames / floor(dur * 30 + 0.5) < 0.9::DOUBLE, false) AS dropped FROM c
      ) SELECT o_orderkey, short_take, dropped, readable AND NOT coalesce(short_take, false) AND (NOT audio_asked OR audio) AND coalesce(frames > 0, true) AS ok,
        CASE WHEN NOT readable THEN 'unreadable' ELSE array_to_string(list_filter([CASE WHEN dur IS NULL THEN 'duration unknown' WHEN short_take THEN 'shorter than asked' ELSE 'as long as asked' END,
          CASE WHEN audio_asked AND NOT audio THEN 'audio missing' WHEN NOT audio_asked AND audio THEN 'audio not asked for' END, CASE WHEN dropped THEN 'frames dropped' END], lambda x: x IS NOT NULL), '; ') END AS notes FROM v""",
    "decode_candidates": """WITH t AS (
        SELECT vec_id AS frame_id, list_transform(embedding, lambda x, i: floor(x::DOUBLE * 64) / 16 + ((i - 1) * 13) % 40) AS data, CASE vec_id % 3 WHEN 0 THEN 20 WHEN 1 THEN 6 ELSE 5 END AS channels,
          CASE vec_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 3 END AS n, vec_id % 3 <> 0 AS first, CASE vec_id % 3 WHEN 2 THEN 4 ELSE 5 END AS skip FROM embeddings
      ), r AS (
        SELECT frame_id, id, skip, list_transform(range(channels), lambda c: data[(CASE WHEN first THEN c * n + id ELSE id * channels + c END) + 1]) AS r FROM (SELECT *, unnest(range(n)) AS id FROM t)
      ), b AS (SELECT *, list_max(r[skip + 1 :]) AS best FROM r), c AS (
        SELECT *, list_position(r[skip + 1 :], best) - 1 AS class, CASE skip WHEN 5 THEN r[5] * best ELSE best END AS sure,
          least(greatest((r[1] - r[3] / 2 - 4) * 2, 0), 60) AS x1, least(greatest((r[1] + r[3] / 2 - 4) * 2, 0), 60) AS x2,
          least(greatest((r[2] - r[4] / 2 - 8) * 2, 0), 50) AS y1, least(greatest((r[2] + r[4] / 2 - 8) * 2, 0), 50) AS y2 FROM b
      ) SELECT frame_id, id, class::BIGINT AS class, 'class_' || class AS label, floor(sure * 10000 + 0.5) / 10000.0::DOUBLE AS score, floor(x1 + 0.5)::BIGINT AS x, floor(y1 + 0.5)::BIGINT AS y,
        floor(x2 - x1 + 0.5)::BIGINT AS w, floor(y2 - y1 + 0.5)::BIGINT AS h FROM c WHERE best > 0 AND sure >= 30""",
    "missing_needs": "WITH h AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS f FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(list_filter(['A', 'N', 'R'], lambda x: NOT list_contains(f, x)), ',') AS missing FROM h",
    "time_grid": f"WITH {_SPEECH} SELECT recording_id, i::INT AS i, floor(i * duration / 7 * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE AS at FROM dur, (SELECT unnest(range(8)) AS i)",
    "parse_list": "SELECT user_id AS list_id, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) AS no, event_type AS name FROM events GROUP BY user_id, event_type",
    "analysis_probe": """WITH z AS (SELECT p_partkey, CASE WHEN p_partkey % 17 <> 0 AND p_partkey % 13 <> 0 AND p_partkey % 2 = 1 AND p_partkey % 7 <> 0 THEN (p_size * 10)::BIGINT END AS w FROM part), r AS (SELECT *, least(1.0, 320.0::DOUBLE / greatest(w, 100)) AS f FROM z)
      SELECT p_partkey, w AS source_width, CASE WHEN w IS NOT NULL THEN 100::BIGINT END AS source_height, CASE WHEN w IS NOT NULL THEN greatest(floor(w * f + 0.5)::BIGINT // 2 * 2, 2) END AS width, CASE WHEN w IS NOT NULL THEN greatest(floor(100 * f + 0.5)::BIGINT // 2 * 2, 2) END AS height FROM r""",
    "config_violations": f"""{_CONFIGS}, v AS (
        SELECT p_partkey, 0 AS no, 'config' AS field, 'must be JSON' AS problem FROM k WHERE p_partkey % 17 = 0
        UNION ALL SELECT p_partkey, 1, 'config.maxConcurrent', 'must be a number between 1 and 8' FROM k WHERE given AND NOT p_size % 10 BETWEEN 1 AND 8
        UNION ALL SELECT p_partkey, 2, 'config.analysis.fps', 'must be a number between 0.5 and 30' FROM k WHERE given AND p_partkey % 13 <> 0 AND (p_partkey % 5 = 0 OR (p_partkey % 5 <> 1 AND NOT p_size / 4 BETWEEN 0.5 AND 30))
        UNION ALL SELECT p_partkey, 3, 'config.analysis.tileSize', 'must be a number between 1 and 100000' FROM k WHERE given AND p_partkey % 13 <> 0 AND p_size % 3 = 0
        UNION ALL SELECT p_partkey, 4, 'config.ocr.provider', CASE p_partkey % 7 WHEN 0 THEN 'must be one of auto, sibling, winrt, off' ELSE 'must be a string or null' END FROM k WHERE given AND p_partkey % 7 <= 1
        UNION ALL SELECT p_partkey, 5, 'config.ocr.scale', 'must be a number between 1 and 3' FROM k WHERE given AND (p_partkey % 6 = 1 OR (p_partkey % 6 > 1 AND NOT p_size % 5 BETWEEN 1 AND 3))
        UNION ALL SELECT p_partkey, 6, 'config.asr.enabled', 'must be a boolean' FROM k WHERE given AND p_partkey % 4 = 0
      ) SELECT p_partkey, (row_number() OVER (PARTITION BY p_partkey ORDER BY no) - 1)::INT AS no, field, problem FROM v""",
    "config_completed": f"""{_CONFIGS} SELECT p_partkey, CASE WHEN given THEN p_size % 10 ELSE 2 END::DOUBLE AS "maxConcurrent", CASE WHEN given AND p_partkey % 13 <> 0 AND p_partkey % 5 <> 1 THEN p_size / 4 ELSE 4 END::DOUBLE AS analysis_fps,
        CASE WHEN given AND p_partkey % 13 <> 0 THEN p_size * 10 ELSE 320 END::DOUBLE AS "analysis_maxSide", CASE WHEN given AND p_partkey % 13 <> 0 THEN p_size % 3 ELSE 16 END::DOUBLE AS "analysis_tileSize", 0.7::DOUBLE AS "analysis_mergeShortSec",
        CASE WHEN given THEN 'off' ELSE 'auto' END AS ocr_provider, CASE WHEN given AND p_partkey % 6 > 0 THEN (p_size % 5)::VARCHAR ELSE 'auto' END AS ocr_scale, NOT given AS asr_enabled, NULL AS asr_language
      FROM k WHERE p_partkey % 17 <> 0 AND NOT (given AND (NOT p_size % 10 BETWEEN 1 AND 8 OR (p_partkey % 13 <> 0 AND (p_partkey % 5 = 0 OR (p_partkey % 5 <> 1 AND NOT p_size / 4 BETWEEN 0.5 AND 30) OR p_size % 3 = 0))
        OR p_partkey % 7 <= 1 OR p_partkey % 6 = 1 OR (p_partkey % 6 > 1 AND NOT p_size % 5 BETWEEN 1 AND 3) OR p_partkey % 4 = 0))""",
    "fuse_segments": f"""WITH RECURSIVE {_PARTS} SELECT f.recording_id, f."index", f.id, f.start, f."end", still."at" AS keyframe_at, {', '.join(f'region.{k} AS share_{k}' for k in _SHARES)}, blocks, tx.n AS text_lines, sha256(tx.text) AS text_sha256,
      y.objects, y.person, CASE WHEN said <> '' THEN said END AS speech, CASE WHEN said <> '' THEN {_R4('sd.seconds')} END AS overlap_seconds, kind, kind_reason
      FROM fin f JOIN whys y ON y.recording_id = f.recording_id AND y."index" = f."index" LEFT JOIN still ON still.recording_id = f.recording_id AND still."index" = f."index" LEFT JOIN region ON region.recording_id = f.recording_id AND region."index" = f."index"
      LEFT JOIN tx ON tx.recording_id = f.recording_id AND tx."index" = f."index" LEFT JOIN sd ON sd.recording_id = f.recording_id AND sd."index" = f."index" """,
    "doc_summary": f"""WITH RECURSIVE {_PARTS}, k AS (SELECT recording_id, string_agg(kind || ':' || ids, ';' ORDER BY kind) AS kinds FROM (SELECT recording_id, kind, string_agg("index"::VARCHAR, ',' ORDER BY "index") AS ids FROM ki GROUP BY ALL) GROUP BY 1),
      c AS (SELECT recording_id, count(*) AS labels, string_agg(label || ':' || n, ';' ORDER BY n DESC, lower(label)) AS counts FROM (SELECT recording_id, label, count(*) AS n FROM ob GROUP BY ALL) GROUP BY 1),
      t AS (SELECT recording_id, sum(n)::BIGINT AS text_lines FROM tx GROUP BY 1), i AS (SELECT recording_id, count(*) AS intervals FROM spk GROUP BY 1), m AS (SELECT recording_id, {', '.join(f"{_R4(f'avg({k})')} AS share_{k}" for k in _SHARES)} FROM region GROUP BY 1), e AS (SELECT recording_id, count(*) AS segment_count, max("end") AS duration FROM fin GROUP BY 1)
      SELECT recording_id, segment_count, coalesce(text_lines, 0) AS text_lines, coalesce(labels, 0) AS objects, coalesce(intervals, 0) AS speech_intervals, duration, kinds, coalesce(counts, '') AS counts, {', '.join(f'share_{k}' for k in _SHARES)}
      FROM e LEFT JOIN k USING (recording_id) LEFT JOIN c USING (recording_id) LEFT JOIN t USING (recording_id) LEFT JOIN i USING (recording_id) LEFT JOIN m USING (recording_id)""",
    "doc_sections": f"""WITH RECURSIVE {_PARTS} SELECT recording_id, section, stat.reason IS NULL AS available, stat.reason FROM recs CROSS JOIN (SELECT unnest(['regions', 'text', 'objects', 'speech']) AS section) LEFT JOIN stat USING (recording_id, section)""",
    "doc_keywords": f"""WITH RECURSIVE {_PARTS}, kw AS (SELECT recording_id, {_KEYWORD} AS term FROM ln), kc AS (SELECT recording_id, term, count(*) AS n FROM kw WHERE length(term) >= 2 AND term NOT IN {_STOPS} GROUP BY ALL)
      SELECT recording_id, (row_number() OVER (PARTITION BY recording_id ORDER BY n DESC, {_PLACE}) - 1)::INT AS no, term, n FROM kc QUALIFY no < 40""",
    "doc_warnings": f"""WITH RECURSIVE {_PARTS}, sn AS (SELECT recording_id, n, coalesce(s, 0) AS s FROM counted LEFT JOIN (SELECT recording_id, count(*) AS s FROM still GROUP BY 1) USING (recording_id)), ws AS (
        SELECT recording_id, 0 AS a, 0 AS i, s || ' stills of ' || n || ' segments' AS said FROM sn WHERE n > s
        UNION ALL SELECT recording_id, CASE section WHEN 'regions' THEN 1 ELSE 2 END, "index", section || ' failed (s' || lpad("index"::VARCHAR, 3, '0') || '): ' || message FROM fail
        UNION ALL SELECT DISTINCT recording_id, 3, 0, 'speech was found, but none of it within a segment' FROM spk WHERE recording_id IN (SELECT recording_id FROM recs) AND recording_id NOT IN (SELECT recording_id FROM sd WHERE said <> '')
      ) SELECT recording_id, coalesce(string_agg(said, '; ' ORDER BY a, i), '') AS warnings FROM recs LEFT JOIN ws USING (recording_id) GROUP BY 1""",
}
SQL |= {f"{_name}_sql": SQL[_name] for _name in ("speech_intervals", "plan_cuts")}
SQL["decode_detections"] = f"""WITH RECURSIVE cand AS ({SQL['decode_candidates']}), o AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, id) AS rn FROM cand), {_SUPPRESSED}
      SELECT cand.*, floor(x + w / 2.0::DOUBLE + 0.5)::BIGINT AS center_x, floor(y + h / 2.0::DOUBLE + 0.5)::BIGINT AS center_y, row_number() OVER (PARTITION BY frame_id ORDER BY cand.score DESC, cand.id) AS rank
      FROM cand JOIN (SELECT frame_id, k.id AS id FROM l) USING (frame_id, id)"""
for _name in ("assign_segments", "assign_unplaced", "merge_intervals"):
    SQL[_name] = SQL[_name].replace("@SPEECH_INTERVALS@", SQL["speech_intervals"])
SQL["top_keywords"] = (
    SQL["keywords"].replace("WITH w AS (SELECT ", "WITH w AS (SELECT source, ").replace("SELECT term, count(*) AS n", ", n AS (SELECT source, term, count(*) AS n").replace("GROUP BY 1", "GROUP BY ALL)")
    + ' SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, translate(term, \'_-.#+\', chr(1) || chr(2) || chr(3) || chr(4) || chr(5))) AS "rank" FROM n WHERE n >= 2) WHERE "rank" <= 40'
)
SQL["keywords_cjk"] = """WITH t AS (SELECT source, unnest(regexp_extract_all(translate(text, 'abcdefghijklmnopqrstuvwxyz', '@CHINESE@'), '[@FIRST@-@LAST@]{2,}')) AS run FROM documents)
      SELECT source, run[i : i + 1] AS term, count(*) AS n FROM (SELECT source, run, unnest(range(1, length(run))) AS i FROM t) GROUP BY ALL"""
for _mark, _text in {"@CHINESE@": "".join(chr(0x4E00 + i) for i in range(26)), "@FIRST@": chr(0x4E00), "@LAST@": chr(0x9FFF)}.items():
    SQL["keywords_cjk"] = SQL["keywords_cjk"].replace(_mark, _text)
