"""DuckDB SQL with the rows of the registered queries, written independently of them."""

from __future__ import annotations

LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
UP = "translate({}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
ITEMS = f"i AS (SELECT item_id, {UP.format('text')} AS t FROM benchmark)"
SEEDS = "s AS (SELECT item_id || '_' || off AS read_id, item_id, off, substring(text, off + 1, 20) AS pattern FROM (SELECT *, unnest(range(0, length(text) - 19, 20)) AS off FROM benchmark))"


def windows(k: int, name: str = "k", text: str = "text") -> str:
    """All substrings of length k of the documents, by pieces of 256."""
    return (
        f"{name} AS (SELECT doc_id, base + o AS pos, substring(part, (o + 1)::INT, {k}) AS w FROM (SELECT doc_id, n, base, substring(text, base + 1, {256 + k - 1}) AS part"
        f" FROM (SELECT doc_id, {text} AS text, length(text) AS n, unnest(range(0, length(text), 256)) AS base FROM documents)), range(0, 256) r(o) WHERE base + o + {k} <= n)"
    )


HITS = f"{SEEDS}, {windows(20)}, h AS (SELECT read_id, item_id, off, doc_id, pos, pattern FROM s JOIN k ON pattern = w), n AS (SELECT read_id, count(*) AS nh FROM h GROUP BY read_id)"
INDEX = "x AS (SELECT doc_id AS seq_id, 'doc' || doc_id AS name, (sum(length(text)) OVER (ORDER BY doc_id) - length(text))::BIGINT AS start, length(text)::BIGINT AS len FROM documents)"
TEXT = f"{ITEMS}, t AS (SELECT string_agg(t, '' ORDER BY item_id) AS t FROM i)"
SA = f"{TEXT}, sa AS (SELECT (row_number() OVER (ORDER BY substring(t, p + 1)) - 1)::BIGINT AS rk, p::BIGINT AS pos FROM (SELECT t, unnest(range(0, length(t) + 1)) AS p FROM t))"
BWT = f"{SA}, b AS (SELECT rk, pos, CASE WHEN pos > 0 THEN substring(t, pos, 1) END AS c FROM sa, t), sz AS (SELECT count(*) AS n FROM sa)"
RUNS = f"""{BWT}, g AS (SELECT *, sum(CASE WHEN rk > 0 AND c IS NOT DISTINCT FROM pc THEN 0 ELSE 1 END) OVER (ORDER BY rk) - 1 AS run
  FROM (SELECT *, lag(c) OVER (ORDER BY rk) AS pc FROM b)),
r AS (SELECT run::BIGINT AS run, any_value(c) AS head, min(rk) AS lo, max(rk) AS hi, count(*) AS len, ((arg_min(pos, rk) + max(n) - 1) % max(n))::BIGINT AS first_tpos, ((arg_max(pos, rk) + max(n) - 1) % max(n))::BIGINT AS last_tpos FROM g, sz GROUP BY run)"""
C = f"{BWT}, ca AS (SELECT c, cnt, (sum(cnt) OVER (ORDER BY c) - cnt + 1)::BIGINT AS c_before FROM (SELECT c, count(*) AS cnt FROM b WHERE c IS NOT NULL GROUP BY c))"
#: Seeds of the items in their index, from the last rank down.
INDEX_HITS = f"""{SA}, q AS (SELECT item_id, o AS off, substring(i.t, (o + 1)::INT, 20) AS w FROM (SELECT *, unnest(range(0, length(t) - 19, 20)) AS o FROM i) i),
ih AS (SELECT item_id, off, row_number() OVER (PARTITION BY item_id, off ORDER BY rk DESC) AS nth, pos FROM q JOIN (SELECT rk, pos, substring(t, (pos + 1)::INT, 20) AS w FROM sa, t) USING (w))"""
CHARS = f"{ITEMS}, ch AS (SELECT item_id, p::BIGINT AS pos, substring(t, (p + 1)::INT, 1) AS c FROM (SELECT *, unnest(range(0, length(t))) AS p FROM i))"
SAM = f"""{HITS}, hh AS (SELECT read_id, doc_id, pos, nh, row_number() OVER (PARTITION BY read_id ORDER BY doc_id, pos) AS nth FROM h JOIN n USING (read_id) WHERE nh <= 4),
sam AS (SELECT 'read_' || s.read_id AS qname, CASE WHEN pos IS NULL THEN 4 WHEN nth > 1 THEN 256 ELSE 0 END::INT AS flag, coalesce('doc' || doc_id, '*') AS rname,
  coalesce((pos + 1)::VARCHAR, '*') AS pos, CASE WHEN pos IS NULL THEN '*' ELSE '255' END AS mapq, '20M' AS cigar, '*' AS rnext, 0 AS pnext, 0 AS tlen,
  CASE WHEN nth > 1 THEN '*' ELSE pattern END AS seq, CASE WHEN nth > 1 THEN '*' ELSE repeat('~', 20) END AS qual, 'NH:i:' || coalesce(nh, 0) || ' ' AS tags
  FROM s LEFT JOIN hh USING (read_id))"""
#: The same with line ends as blanks.
SAM_OF_LINES = SAM.replace("FROM benchmark", "FROM (SELECT item_id, replace(text, chr(10), ' ') AS text FROM benchmark)").replace("FROM documents", "FROM (SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents)")
REFS = f"""{SAM}, u AS (SELECT qname FROM sam WHERE flag & 4 = 0 GROUP BY qname HAVING count(DISTINCT pos) = 1),
ref AS (SELECT pos::BIGINT AS pos, list_sort(list(DISTINCT rname)) AS refs FROM sam JOIN u USING (qname) WHERE flag & 4 = 0 GROUP BY pos)"""
CLUSTERS = f"""{REFS}, o AS (SELECT *, row_number() OVER (ORDER BY pos) AS rn FROM ref),
f AS (SELECT rn, 0 AS cluster, pos AS first_pos, pos AS last_pos, 1 AS n_pos, refs FROM o WHERE rn = 1
  UNION ALL SELECT o.rn, CASE WHEN len(list_intersect(f.refs, o.refs)) > 0 THEN cluster ELSE cluster + 1 END, CASE WHEN len(list_intersect(f.refs, o.refs)) > 0 THEN first_pos ELSE pos END, pos,
    CASE WHEN len(list_intersect(f.refs, o.refs)) > 0 THEN n_pos + 1 ELSE 1 END, CASE WHEN len(list_intersect(f.refs, o.refs)) > 0 THEN list_intersect(f.refs, o.refs) ELSE o.refs END
  FROM f JOIN o ON o.rn = f.rn + 1),
cl AS (SELECT cluster::INT AS cluster, max(first_pos) AS first_pos, max(last_pos) AS last_pos, max(n_pos)::BIGINT AS n_pos, list_sort(arg_max(refs, rn)) AS refs FROM f GROUP BY cluster)"""
POPULAR = f"{CLUSTERS}, pop AS (SELECT ref, count(*) AS n FROM (SELECT unnest(refs) AS ref FROM cl) GROUP BY ref)"

BROKEN = f"{ITEMS}, r AS (SELECT item_id, {UP.format("left(text, 25) || chr(167) || substring(text, 26)")} AS p FROM benchmark)"
#: Greedy segments from the right: before the letter at pos is looked at, a segment ends at e.
SEGMENTS = f"""{BROKEN}, st AS (SELECT item_id, p, length(p) - 1 AS pos, length(p) - 1 AS e, 0 AS seg FROM r UNION ALL
  SELECT item_id, p, pos - 1, CASE WHEN found THEN e ELSE pos - 1 END, CASE WHEN found THEN seg ELSE seg + 1 END
  FROM (SELECT *, EXISTS (SELECT 1 FROM i WHERE contains(i.t, substring(p, pos + 1, e - pos + 1))) AS found FROM st WHERE pos >= 0)),
sg AS (SELECT item_id, seg::INT AS segment, (min(pos) + 1)::BIGINT AS seg_start, max(e)::BIGINT AS seg_end, any_value(p) AS p FROM st GROUP BY item_id, seg),
sh AS (SELECT item_id, segment, ref, unnest(list_filter(range(1, length(t) - length(w) + 2), lambda j: substring(t, j, length(w)) = w)) - 1 AS pos
  FROM (SELECT sg.item_id, segment, substring(p, seg_start::INT + 1, (seg_end - seg_start + 1)::INT) AS w, i.item_id AS ref, i.t FROM sg, i WHERE seg_end >= seg_start) WHERE contains(t, w)),
sn AS (SELECT item_id, segment, count(*) AS occ FROM sh GROUP BY ALL)"""
EDGES = f"""{RUNS}, l AS (SELECT run, first_tpos, coalesce(lead(first_tpos) OVER (ORDER BY first_tpos) - first_tpos, 1) AS lim FROM r),
ed AS (SELECT e.run, p.run AS next, x - p.first_tpos AS cost, l.lim AS lim FROM (SELECT run + 1 AS run, last_tpos AS x FROM r WHERE run + 1 IN (SELECT run FROM r)) e
  ASOF JOIN (SELECT run, first_tpos FROM r) p ON e.x >= p.first_tpos JOIN l ON l.run = e.run)"""
#: The paths of the cover with their edges, by place: each run belongs to the least root that reaches it, and a root's runs follow each other.
PATHS = f"""{EDGES}, w AS (SELECT run AS root, run FROM ed WHERE run NOT IN (SELECT next FROM ed) UNION SELECT root, next FROM w JOIN ed USING (run) WHERE next > 0),
ow AS (SELECT run, min(root) AS root FROM w GROUP BY run), lo AS (SELECT root, count(*) AS n FROM ow GROUP BY root HAVING count(*) >= 16),
pl AS (SELECT root, root AS run, 0 AS place, n FROM lo UNION ALL SELECT root, next, place + 1, n FROM pl JOIN ed USING (run) WHERE place + 1 < n),
pa AS (SELECT root AS path, place::BIGINT AS place, run, cost, lim - 1 AS lim, n, sum(cost) OVER (PARTITION BY root ORDER BY place) - cost AS before FROM pl JOIN ed USING (run)),
ph AS (SELECT *, ceil(log2(n))::INT AS h FROM pa)"""

ORACLES = {
    "seed_count": f"WITH {HITS} SELECT p AS seed, count(doc_id) AS occ FROM (SELECT DISTINCT pattern AS p FROM s) LEFT JOIN (SELECT DISTINCT pattern, doc_id, pos FROM h) ON p = pattern GROUP BY p",
    "seed_locate": f"WITH {HITS} SELECT item_id, off, doc_id, pos FROM h",
    "stream_seed_locate": f"WITH {HITS} SELECT item_id, off, doc_id, pos FROM h",
    "seed_locate_max_range": f"WITH {HITS} SELECT read_id, doc_id, pos, nh FROM h JOIN n USING (read_id) WHERE nh <= 4",
    "seed_unlocated_flags": f"WITH {HITS} SELECT read_id, coalesce(nh, 0) AS nh, CASE WHEN nh <= 4 THEN 0 ELSE 4 END AS flag FROM s LEFT JOIN n USING (read_id)",
    "seed_first_hits": f"WITH {HITS}, o AS (SELECT read_id, h.doc_id, pos, row_number() OVER (PARTITION BY read_id ORDER BY substring(text, pos + 1) DESC, h.doc_id, pos)::INT AS nth FROM h JOIN documents USING (doc_id)) SELECT * FROM o WHERE nth <= 2",
    "passage_contains": "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
    "batch_stats": f"WITH {HITS} SELECT count(*) AS patterns, sum(coalesce(nh, 0))::BIGINT AS occurrences, sum(coalesce(nh, 0)) / count(*) AS per_pattern FROM s LEFT JOIN n USING (read_id)",
    "occurrence_check": f"WITH {HITS} SELECT count(*) AS hits, 0::BIGINT AS wrong, 0::BIGINT AS twice FROM h",
    "seq_index": f"WITH {INDEX} SELECT * FROM x",
    "ref_lengths": f"WITH {INDEX} SELECT name, len FROM x WHERE len > 0",
    "resolve_offset": f"WITH {INDEX}, q AS (SELECT unnest(range(0, (SELECT sum(len) FROM x)::BIGINT)) AS x) SELECT q.x, name, q.x - start AS off FROM q ASOF JOIN (SELECT * FROM x WHERE len > 0) y ON q.x >= y.start",
    "longest_suffix": """WITH RECURSIVE q AS (SELECT item_id AS read_id, left(text, length(text) - 12) || chr(167) || right(text, 11) AS p FROM benchmark UNION ALL SELECT item_id + 1000000, text FROM benchmark),
      -- a suffix of a suffix that occurs occurs, too: the longest one by halving
      h AS (SELECT read_id, p, 0 AS lo, length(p) AS hi FROM q UNION ALL
        SELECT read_id, p, CASE WHEN found THEN mid ELSE lo END, CASE WHEN found THEN hi ELSE mid - 1 END
        FROM (SELECT read_id, p, lo, hi, (lo + hi + 1) // 2 AS mid, EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, right(p, (lo + hi + 1) // 2))) AS found FROM h WHERE lo < hi)),
      c AS (SELECT read_id, p, lo AS m, right(p, lo) AS w FROM h WHERE lo = hi)
      SELECT read_id, m::BIGINT AS match_len, CASE WHEN m = 0 THEN 0 ELSE coalesce((SELECT sum(len(list_filter(range(1, length(d.text) - m + 2), lambda j: substring(d.text, j, m) = w))) FROM documents d WHERE contains(d.text, w)), 0) END::BIGINT AS occ FROM c""",
    "char_c_array": f"WITH {C} SELECT * FROM ca",
    "char_rank_select": f"WITH {CHARS} SELECT item_id, pos, c, row_number() OVER (PARTITION BY item_id, c ORDER BY pos) - 1 AS rank FROM ch",
    "run_length_encode": f"WITH {CHARS}, y AS (SELECT *, lag(c) OVER (PARTITION BY item_id ORDER BY pos) AS p FROM ch), z AS (SELECT *, sum((p IS NULL OR p <> c)::INT) OVER (PARTITION BY item_id ORDER BY pos) - 1 AS run FROM y) SELECT item_id, run::BIGINT AS run, any_value(c) AS c, min(pos) AS lo, max(pos) AS hi FROM z GROUP BY item_id, run",
    "gap_at": f"WITH {CHARS} SELECT item_id, pos, c, pos - lag(pos, 1, -1) OVER (PARTITION BY item_id, c ORDER BY pos) AS gap FROM ch",
    "suffix_array": f"WITH {SA} SELECT * FROM sa",
    "bwt": f"WITH {BWT} SELECT rk, c FROM b",
    "bwt_runs": f"WITH {RUNS} SELECT * FROM r",
    "bwt_decoded": f"WITH {BWT} SELECT string_agg(coalesce(c, '$'), '' ORDER BY rk) AS bwt FROM b",
    "suffix_array_from_bwt": f"WITH {SA} SELECT * FROM sa",
    "lf_mapping": f"WITH {BWT} SELECT rk, (row_number() OVER (ORDER BY c NULLS FIRST, rk) - 1)::BIGINT AS lf FROM b",
    "first_column": f"WITH {BWT} SELECT rk, CASE WHEN rk > 0 THEN substring(t, pos + 1, 1) END AS f FROM b, t",
    "phi": f"WITH {SA}, p AS (SELECT rk, pos, lag(pos) OVER (ORDER BY rk) AS phi FROM sa) SELECT pos, phi FROM p WHERE rk > 0",
    "phi_by_samples": f"WITH {SA}, p AS (SELECT rk, pos, lag(pos) OVER (ORDER BY rk) AS phi FROM sa) SELECT pos, phi FROM p WHERE rk > 0",
    "access_sa": f"WITH {SA}, p AS (SELECT rk, pos, lag(pos) OVER (ORDER BY rk) AS phi FROM sa) SELECT * FROM p WHERE rk > 0",
    "sa_range_print": f"WITH {SA} SELECT rk, rk || ': ' || pos AS value FROM sa WHERE rk BETWEEN 10 AND 60",
    "build_stats": f"WITH {RUNS} SELECT sum(len)::BIGINT AS n, count(*) AS r, sum(len) / count(*) AS n_over_r, log2(count(*)) AS log2_r, log2(sum(len) / count(*)) AS log2_n_over_r FROM r",
    "space_report": f"WITH {RUNS} SELECT 'bwt_runs' AS component, count(*) AS n_rows, 7::BIGINT AS n_columns FROM r UNION ALL SELECT 'sa', count(*), 2 FROM sa UNION ALL SELECT 'letters', count(*) - 1, 2 FROM sa",
    "predecessor_circular": f"WITH {RUNS}, q AS (SELECT unnest(range(0, (SELECT count(*) FROM sa))) AS x) SELECT x, coalesce(r.first_tpos, (SELECT max(first_tpos) FROM r)) AS first_tpos FROM q ASOF LEFT JOIN r ON q.x > r.first_tpos",
    "break_range": f"WITH {RUNS}, q AS (SELECT unnest(range(0, (SELECT max(hi) + 1 FROM r), 500)) AS a) SELECT a // 500 AS q, head AS c, greatest(lo, a) AS lo, least(hi, a + 499) AS hi FROM r JOIN q ON hi >= a AND lo <= a + 499 WHERE head IS NOT NULL",
    "closest_run_break": f"WITH {RUNS}, q AS (SELECT unnest(range(0, (SELECT max(hi) + 1 FROM r), 500)) AS a) SELECT a // 500 AS q, head AS c, min(CASE WHEN lo > a THEN lo ELSE least(hi, a + 499) END) AS place FROM r JOIN q ON hi >= a AND lo <= a + 499 WHERE head IS NOT NULL GROUP BY ALL",
    "backward_ranges": f"WITH {SA}, k AS (SELECT rk, pos, substring(t, pos + 1) AS w FROM sa, t) SELECT i.item_id, min(rk) AS lo, max(rk) AS hi, arg_max(pos, rk) AS toehold FROM i JOIN k ON starts_with(k.w, i.t) WHERE i.t <> '' GROUP BY ALL",
    "index_locate": f"WITH {INDEX_HITS} SELECT * FROM ih",
    "index_first_hits": f"WITH {INDEX_HITS} SELECT * FROM ih WHERE nth <= 2",
    "rank_questions": f"WITH {BWT}, q AS (SELECT p::BIGINT AS i, substring(t, (p + 1)::INT, 1) AS c FROM (SELECT t, unnest(range(0, length(t))) AS p FROM t)), o AS (SELECT rk, c, row_number() OVER (PARTITION BY c ORDER BY rk) AS k FROM b) SELECT i, q.c, coalesce(k, 0) AS rank FROM q ASOF LEFT JOIN o ON q.c = o.c AND q.i > o.rk",
    "select_questions": f"WITH {BWT}, q AS (SELECT p::BIGINT AS k, substring(t, (p + 1)::INT, 1) AS c FROM (SELECT t, unnest(range(0, length(t))) AS p FROM t)), o AS (SELECT rk, c, row_number() OVER (PARTITION BY c ORDER BY rk) - 1 AS k FROM b) SELECT q.k, q.c, rk AS place FROM q LEFT JOIN o ON q.c = o.c AND q.k = o.k",
    "run_graph_edges": f"WITH {EDGES} SELECT run, next, cost, lim AS limit FROM ed",
    "run_graph_double_edges": f"WITH {EDGES} SELECT a.run, b.next, a.cost + b.cost AS cost, least(a.lim, b.lim - a.cost) AS limit FROM ed a JOIN ed b ON b.run = a.next",
    "run_graph_walks": f"""WITH RECURSIVE {EDGES}, w AS (SELECT run AS q, run, 0::BIGINT AS ahead, 0::BIGINT AS steps FROM ed UNION ALL
      SELECT q, next, ahead + cost, steps + 1 FROM w JOIN ed USING (run) WHERE ahead < lim AND steps < 7) SELECT q, arg_max(run, steps) AS run, arg_max(ahead, steps) AS ahead, max(steps) AS steps FROM w GROUP BY q""",
    "path_cover": f"""WITH RECURSIVE {EDGES}, w AS (SELECT run AS root, run FROM ed WHERE run NOT IN (SELECT next FROM ed) UNION SELECT root, next FROM w JOIN ed USING (run) WHERE next > 0),
      o AS (SELECT run, min(root) AS root FROM w GROUP BY run) SELECT root, count(*) AS n FROM o GROUP BY root HAVING count(*) >= 16""",
    "path_trees": f"""WITH RECURSIVE {PATHS} SELECT path, ((1::BIGINT << h) + place) >> k AS node, sum(cost)::BIGINT AS cost, (min(lim - before) + min(before))::BIGINT AS limit
      FROM ph, range(0, 40) r(k) WHERE k <= h GROUP BY path, k, ((1::BIGINT << h) + place) >> k HAVING count(*) = 1::BIGINT << k""",
    "tree_walks": f"""WITH RECURSIVE {PATHS}, tw AS (SELECT run AS q, path, place, 0::BIGINT AS cost, 0 AS steps FROM ph UNION ALL
      SELECT q, tw.path, tw.place + 1, tw.cost + ph.cost, steps + 1 FROM tw JOIN ph ON ph.path = tw.path AND ph.place = tw.place WHERE steps < 40 AND ph.lim >= tw.cost AND tw.place < n - 1)
      SELECT q, ph.run, x.steps::BIGINT AS steps, x.cost FROM (SELECT q, any_value(path) AS path, arg_max(place, steps) AS place, max(steps) AS steps, arg_max(cost, steps) AS cost FROM tw GROUP BY q) x JOIN ph USING (path, place)""",
    "sam_records": f"WITH {SAM} SELECT * FROM sam",
    "sam_lines": f"WITH {SAM} SELECT concat_ws(chr(9), qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual, tags) AS value FROM sam",
    "sam_header": "SELECT -1 AS ord, '@HD' || chr(9) || 'VN:1.6' || chr(9) || 'SO:unknown' AS value UNION ALL SELECT doc_id, '@SQ' || chr(9) || 'SN:doc' || doc_id || chr(9) || 'LN:' || length(text) FROM documents",
    "sam_filter": f"WITH {SAM} SELECT qname, rname, pos FROM sam WHERE flag & 256 <> 0",
    "sam_remove_repeats": f"WITH {SAM} SELECT qname, flag, rname, pos FROM sam WHERE qname IN (SELECT qname FROM sam GROUP BY qname HAVING count(*) = count(DISTINCT flag))",
    "sam_vs_truth": f"WITH {SAM}, tr AS (SELECT DISTINCT 'read_' || read_id AS qname, (first(pos ORDER BY doc_id, pos) + 1)::VARCHAR AS pos FROM h GROUP BY read_id) SELECT count(*) FILTER (flag & 4 <> 0) AS unaligned, count(*) FILTER (flag & 4 = 0 AND (qname, pos) NOT IN (SELECT (qname, pos) FROM tr)) AS incorrect, count(*) AS total FROM sam",
    "unique_pos_ref_sets": f"WITH {REFS} SELECT pos, array_to_string(refs, ',') AS refs FROM ref",
    "all_refs": f"WITH {SAM} SELECT DISTINCT rname FROM sam WHERE flag & 4 = 0",
    "mosaic_clusters": f"WITH RECURSIVE {CLUSTERS} SELECT cluster, first_pos, last_pos, n_pos, array_to_string(refs, ',') AS refs FROM cl",
    "mosaic_popularity": f"WITH RECURSIVE {POPULAR} SELECT * FROM pop",
    "mosaic_tiles": f"""WITH RECURSIVE {POPULAR}, le AS (SELECT max(length(text)) AS total FROM documents), ch AS (SELECT cluster, first(ref ORDER BY ref <> 'doc0', n DESC, ref) AS ref FROM (SELECT cluster, unnest(refs) AS ref FROM cl) JOIN pop USING (ref) GROUP BY cluster),
      e AS (SELECT first_pos AS a, least(coalesce(lead(first_pos) OVER (ORDER BY first_pos) - 1, total), last_pos + 19, total) AS b, ref, lead(first_pos) OVER (ORDER BY first_pos) AS nx, row_number() OVER (ORDER BY first_pos) AS k FROM cl JOIN ch USING (cluster), le),
      al AS (SELECT a, b, ref FROM e UNION ALL SELECT b + 1, coalesce(nx - 1, total), 'doc0' FROM e, le WHERE b + 1 <= coalesce(nx - 1, total) UNION ALL SELECT 1, a - 1, 'doc0' FROM e WHERE k = 1 AND a > 1)
      SELECT a::BIGINT AS a, b::BIGINT AS b, ref, ref || ':' || a || '-' || b AS name FROM al""",
    "offset_to_chromosome": f"WITH {HITS} SELECT read_id, 0 AS flag, 'doc' || doc_id AS rname, (pos + 1)::VARCHAR AS pos FROM h UNION ALL SELECT read_id, 4, '*', '*' FROM s WHERE read_id NOT IN (SELECT read_id FROM h)",
    "hamming_window_scan": f"""WITH p AS (SELECT item_id, {LOW.format('text')} AS p, length(text) AS m FROM benchmark), d AS (SELECT doc_id, {LOW.format('text')} AS t FROM documents),
      -- of seven parts of a pattern one is free of fewer than seven differences; its first 12 letters are looked up
      s AS (SELECT item_id, p, m, (i * m) // 7 AS o, substring(p, ((i * m) // 7 + 1)::INT, 12) AS k FROM p, range(0, 7) r(i) WHERE m >= 84), {windows(12, text=LOW.format('text'))},
      c AS (SELECT DISTINCT item_id, doc_id, pos - o AS pos FROM s JOIN k ON s.k = k.w WHERE pos >= o),
      w AS (SELECT item_id, doc_id, pos, p, substring(t, (pos + 1)::INT, m::INT) AS w FROM c JOIN p USING (item_id) JOIN d USING (doc_id) WHERE pos + m <= length(t))
      SELECT item_id, doc_id, pos, w, d FROM (SELECT *, len(list_filter(range(1, length(p) + 1), lambda j: substring(w, j, 1) <> substring(p, j, 1)))::INT AS d FROM w) WHERE d < 7""",
    "inexact_locate": f"""WITH {SEEDS}, {windows(20)}, p AS (SELECT read_id, substring(pattern, 1, 7) AS a, substring(pattern, 9, 12) AS b, substring(pattern, 1, 7) || '#' || substring(pattern, 9) AS p FROM s),
      c AS (SELECT read_id, doc_id, pos, p, w FROM p JOIN k ON substring(w, 1, 7) = a AND substring(w, 9, 12) = b UNION SELECT read_id, doc_id, pos, p, w FROM p JOIN k ON substring(w, 11, 10) = substring(p, 11, 10) UNION SELECT read_id, doc_id, pos, p, w FROM p JOIN k ON substring(w, 1, 10) = substring(p, 1, 10)),
      z AS (SELECT read_id, doc_id, pos, len(list_filter(range(1, 21), lambda j: substring(w, j, 1) <> substring(p, j, 1)))::INT AS mismatches FROM c) SELECT * FROM z WHERE mismatches <= 1""",
    "sql_hits": f"WITH {HITS}, {INDEX} SELECT read_id, name, pos, start + pos AS x, nh AS occ FROM h JOIN n USING (read_id) JOIN x ON x.seq_id = h.doc_id",
    "piecewise_segments": f"WITH RECURSIVE {SEGMENTS} SELECT item_id, segment, seg_start, seg_end, coalesce(occ, 0) AS occ, seg_end + (segment > 0)::INT AS legacy_end FROM sg LEFT JOIN sn USING (item_id, segment)",
    "piecewise_records": f"""WITH RECURSIVE {SEGMENTS}, z AS (SELECT item_id, segment, p, seg_start, seg_end, length(p) AS m, coalesce(occ, 0) AS nh, ref, pos, row_number() OVER (PARTITION BY item_id, segment ORDER BY ref, pos) AS nth
        FROM sg LEFT JOIN sn USING (item_id, segment) LEFT JOIN (SELECT sh.* FROM sh JOIN sn USING (item_id, segment) WHERE occ <= 5) USING (item_id, segment))
      SELECT 'read_' || item_id AS qname, CASE WHEN pos IS NULL THEN 4 WHEN nth > 1 THEN 256 ELSE 0 END::INT AS flag, coalesce('item' || ref, '*') AS rname, coalesce((pos + 1)::VARCHAR, '*') AS pos,
        CASE WHEN pos IS NULL THEN '*' ELSE '255' END AS mapq, CASE WHEN seg_start > 0 THEN seg_start || 'S' ELSE '' END || (seg_end - seg_start + 1) || 'M' || CASE WHEN m - seg_end - 1 > 0 THEN (m - seg_end - 1) || 'S' ELSE '' END AS cigar,
        '*' AS rnext, 0 AS pnext, 0 AS tlen, CASE WHEN nth > 1 THEN '*' ELSE p END AS seq, CASE WHEN nth > 1 THEN '*' ELSE repeat('~', m) END AS qual, 'NH:i:' || nh || ' ' AS tags FROM z""",
    "prefix_differences": f"""WITH RECURSIVE {BROKEN}, st AS (SELECT item_id, p, -1 AS k, 0 AS a, 0 AS n FROM r UNION ALL
      SELECT item_id, p, k + 1, CASE WHEN found THEN a ELSE k + 2 END, CASE WHEN found THEN n ELSE n + 1 END
      FROM (SELECT *, EXISTS (SELECT 1 FROM i WHERE contains(i.t, substring(p, a + 1, k - a + 2))) AS found FROM st WHERE k + 1 < length(p))) SELECT item_id, k::INT AS i, n::INT AS d FROM st WHERE k >= 0""",
    "fasta_round_trip": f"WITH {ITEMS} SELECT 'item' || item_id AS name, replace(t, chr(10), '') AS seq FROM i",
    "fastq_round_trip": f"WITH {SEEDS} SELECT 'seq_' || read_id AS name, replace(pattern, chr(10), ' ') AS seq, repeat('~', 20) AS qual FROM s",
    "fastq_split_read": f"WITH {SEEDS} SELECT row_number() OVER (ORDER BY item_id, off) - 1 AS ord, 'seq_' || read_id AS name, replace(pattern, chr(10), ' ') AS seq, repeat('~', 20) AS qual FROM s",
    "random_dna": "SELECT item_id, array_to_string(list_transform(range(1, length(text) + 1), lambda i: substring('ACGTACGTACGTACGT', ('0x' || left(md5(item_id || ':' || i), 1))::INT + 1, 1)), '') AS seq FROM benchmark",
    "first_reads": f"WITH {SEEDS} SELECT 'seq_' || read_id AS name FROM s ORDER BY item_id, off LIMIT 5",
    "plain_text_round_trip": "SELECT length(t)::BIGINT AS n_chars, sha256(t) AS digest FROM (SELECT string_agg(text || chr(10), '' ORDER BY item_id) AS t FROM benchmark) WHERE t IS NOT NULL",
    "index_round_trip": f"WITH {RUNS} SELECT * FROM r",
    "seq_index_round_trip": f"WITH {INDEX} SELECT name, start FROM x",
    "fai_round_trip": f"WITH {INDEX} SELECT name, len FROM x",
    "pattern_round_trip": f"WITH {SEEDS} SELECT row_number() OVER (ORDER BY item_id, off) - 1 AS read_id, pattern FROM s",
    "pattern_header_fields": f"WITH {SEEDS} SELECT count(*) AS number, 20::BIGINT AS length FROM s",
    "sam_round_trip": f"WITH {SAM_OF_LINES} SELECT * FROM sam",
    "sam_header_round_trip": "SELECT '@HD' || chr(9) || 'VN:1.6' || chr(9) || 'SO:unknown' AS value UNION ALL SELECT '@SQ' || chr(9) || 'SN:doc' || doc_id || chr(9) || 'LN:' || length(text) FROM documents",
    "population_round_trip": "SELECT n_nationkey::VARCHAR AS sample, n_name AS pop, n_regionkey::VARCHAR AS super_pop FROM nation",
    "occurrence_lines": f"WITH {HITS} SELECT pos::VARCHAR AS value FROM h",
    "reserved_check": r"SELECT doc_id, regexp_matches(text, '[\x00\x01]') AS reserved FROM documents",
    "sam_of_haplotype": f"WITH {SAM} SELECT qname, rname, pos FROM sam WHERE contains(qname, '_0')",
    "durations": "SELECT doc_id, printf('%d seconds. (%dh %dm %ds)', n_chars, n_chars // 3600, n_chars % 3600 // 60, n_chars % 60) AS took FROM documents",
    "align_fastq": f"WITH {SAM_OF_LINES} SELECT * FROM sam",
    "align_to_chromosome": f"WITH {HITS} SELECT 'read_' || s.read_id AS qname, CASE WHEN pos IS NULL THEN 4 WHEN row_number() OVER (PARTITION BY s.read_id ORDER BY doc_id, pos) > 1 THEN 256 ELSE 0 END::INT AS flag, coalesce('doc' || doc_id, '*') AS rname, coalesce((pos + 1)::VARCHAR, '*') AS pos FROM s LEFT JOIN (SELECT h.* FROM h JOIN n USING (read_id) WHERE nh <= 4) USING (read_id)",
    "d_neighbours": f"WITH {ITEMS}, a AS (SELECT regexp_replace(t, '[^ACGT]', '', 'g') AS t FROM i), k AS (SELECT DISTINCT substring(t, (o + 1)::INT, 5) AS word FROM (SELECT t, unnest(range(0, length(t) - 4)) AS o FROM a)), l AS (SELECT unnest(['A', 'C', 'G', 'T']) AS c), w AS (SELECT a.c || b.c || d.c || e.c || f.c AS w FROM l a, l b, l d, l e, l f) SELECT word, w AS neighbour FROM k, w WHERE hamming(w, word) <= 2",
    "chimera": """WITH p AS (SELECT 'item' || a.item_id || '+item' || b.item_id AS name, a.text AS x, b.text AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)
      SELECT name, string_agg(substring(CASE WHEN k % 2 = 0 THEN x ELSE y END, (k * 30 + 1)::INT, 30), '' ORDER BY k) AS seq FROM (SELECT *, unnest(range(0, (least(length(x), length(y)) + 29) // 30)) AS k FROM p) GROUP BY name""",
    "simulated_alignment": "SELECT count(*) AS reads, count(*) AS found FROM documents WHERE length(text) >= 60",
    "clip_columns": "SELECT doc_id, CASE WHEN a > 0 THEN a || 'S' ELSE '' END || (m - z - a) || 'M' || CASE WHEN z > 0 THEN z || 'S' ELSE '' END AS cigar, (m - z - a)::BIGINT AS aligned, a AS clip, length(bin(m))::INT AS bits FROM (SELECT doc_id, length(text) AS m, length(text) % 11 AS a, length(text) % 7 AS z FROM documents WHERE length(text) >= 20)",
    "regions": f"SELECT doc_id, substring(text, 11, 30) AS part, regexp_replace({UP.format('text')}, '[^ACGT]', '', 'g') AS acgt FROM documents",
    "fasta_lines": rf"WITH {ITEMS} SELECT '>item' || item_id || chr(10) || rtrim(regexp_replace(replace(t, chr(10), ''), '(.{{60}})', '\1' || chr(10), 'g'), chr(10)) AS value FROM i",
    "seed_fastq": f"WITH {SEEDS} SELECT '@seq_' || read_id || chr(10) || pattern || chr(10) || '+' || chr(10) || repeat('~', 20) AS value FROM s",
    "seed_patterns": f"WITH {SEEDS} SELECT -1 AS ord, '# number=' || count(*) || ' length=20 file=seeds forbidden=' AS value FROM s UNION ALL SELECT item_id * 100000 + off, pattern FROM s",
    "count_lines": f"WITH {HITS} SELECT read_id || ' ' || chr(9) || CASE WHEN nh > 0 THEN 20 ELSE 0 END || '/20' || chr(9) || coalesce(nh, 0) AS value FROM s LEFT JOIN n USING (read_id)",
}
ORACLES["prefix_free_runs"] = ORACLES["bwt_runs"]
# the documents stand end to end there; a text of the benchmark that lies over their seams counts, too
ORACLES["document_passages"] = f"""WITH {ITEMS}, t AS (SELECT string_agg({UP.format('text')}, '' ORDER BY doc_id) AS t FROM documents)
  SELECT item_id, CASE WHEN i.t = '' THEN 0 ELSE (length(t.t) - length(replace(t.t, i.t, ''))) // length(i.t) END::BIGINT AS occ FROM i, t"""
ORACLES["fasta_split_read"] = ORACLES["fasta_round_trip"]
ORACLES["mosaic_pipeline"] = ORACLES["mosaic_tiles"]
ORACLES["mosaic_tiles_extended"] = ORACLES["mosaic_tiles"].replace("last_pos + 19, ", "")
ORACLES["mosaic_parts"] = f"SELECT a, b, ref, sha256(substring(text, a, b - a + 1)) AS digest FROM ({ORACLES['mosaic_tiles']}) JOIN documents ON ref = 'doc' || doc_id"
