"""The SQL of each query, for an engine with RE2 expressions; names as in queries.py."""

from __future__ import annotations

from spanloom.functions.text import SPACE_CLASS
from spanloom.operators.release import EXCLUDED, INCLUDED
from spanloom.plans.fixtures import N_LABELS, TOKENS_PER_RECORD
from spanloom.plans.queries import CANDIDATES, COVERAGE, HEAD_GRID, LOGIT_GRID, MAX_LENGTH, NEXT_GRID, PADDED, PROB_GRID


def _re2(java_class: str) -> str:
    """The class with code points above 7F written as RE2 writes them."""
    out, parts = "", java_class.split("\\")
    for p in parts[1:]:
        width = {"u": 5, "x": 3}[p[0]]
        out += f"\\x{{{p[1:width]}}}{p[width:]}"
    return out


SPACE = _re2(SPACE_CLASS)
L = N_LABELS

TOKENS = rf"""
tiles AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[{SPACE}]+|(?s:.)') AS p FROM documents)),
offs AS (SELECT doc_id, i, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM tiles),
plain AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS pos, CAST(e - length(piece) AS INTEGER) AS s, CAST(e AS INTEGER) AS e, piece AS token FROM offs WHERE NOT regexp_matches(piece, '^[{SPACE}]')),
tok AS (SELECT doc_id, pos // {TOKENS_PER_RECORD} AS rec, pos, s, e, token, e - s AS n, lead(e) OVER (PARTITION BY doc_id ORDER BY pos) AS ne FROM plain)"""

GOLD = rf"""{TOKENS},
gold AS (
  SELECT doc_id, rec, pos, n, 0 AS kind, s, e, 'L' || ((n + pos) % {L}) AS label, pos * 4 AS ordinal FROM tok WHERE pos % 3 = 0
  UNION ALL SELECT doc_id, rec, pos, n, 1, s, e, 'L' || ((n + pos + 2) % {L}), pos * 4 + 1 FROM tok WHERE pos % 15 = 0
  UNION ALL SELECT doc_id, rec, pos, n, 2, s, ne, 'L' || ((n + pos + 1) % {L}), pos * 4 + 2 FROM tok WHERE pos % 6 = 0 AND ne IS NOT NULL)"""

PRED = rf"""{GOLD},
pred AS (
  SELECT doc_id, rec, s, CASE WHEN pos % 5 = 0 AND e - s > 1 THEN e - 1 ELSE e END AS e, CASE WHEN pos % 11 = 0 THEN 'L' || ((n + pos + kind + 3) % {L}) ELSE label END AS label, ordinal FROM gold WHERE pos % 7 <> 0
  UNION ALL SELECT doc_id, rec, s, e, 'L' || ((n + pos) % {L}), pos * 4 + 3 FROM tok WHERE pos % 13 = 1),
both_ AS (SELECT doc_id, rec, s, e, label, ordinal, 'g' AS side FROM gold UNION ALL SELECT doc_id, rec, s, e, label, ordinal, 'p' FROM pred)"""


def _marked(keys: str) -> str:
    """Exact matches of both_."""
    return f"""
marked AS (
  SELECT *, row_number() OVER (PARTITION BY {keys}, s, e, label, side ORDER BY ordinal) <= least(count(*) FILTER (side = 'g') OVER m, count(*) FILTER (side = 'p') OVER m) AS exact
  FROM both_ WINDOW m AS (PARTITION BY {keys}, s, e, label))"""


# Greedy overlap by recursion over the left reference mentions of each record and label.
def _outcomes(ctes: str, keys: str) -> str:
    """The five counts of each record (keys) and label of both_, which the ctes define."""
    return rf"""RECURSIVE {ctes.lstrip().removeprefix("RECURSIVE")},{_marked(keys)},
groups AS (
  SELECT {keys}, label, count(*) FILTER (side = 'g' AND exact) AS correct,
    coalesce(list({{'s': s, 'o': ordinal, 'e': e}} ORDER BY s, ordinal) FILTER (side = 'g' AND NOT exact), []) AS golds,
    coalesce(list({{'l': e - s, 's': s, 'o': ordinal, 'e': e}} ORDER BY e - s, s, ordinal) FILTER (side = 'p' AND NOT exact), []) AS preds
  FROM marked GROUP BY ALL),
fold({keys}, label, k, golds, preds, lost, hits) AS (
  SELECT {keys}, label, 0, golds, preds, golds[1:0], 0 FROM groups
  UNION ALL
  SELECT {keys}, label, k + 1, golds, CASE WHEN o IS NULL THEN preds ELSE list_filter(preds, lambda p: p.o <> o) END, CASE WHEN o IS NULL THEN list_append(lost, golds[k + 1]) ELSE lost END, hits + CASE WHEN o IS NULL THEN 0 ELSE 1 END
  FROM (SELECT *, list_filter(preds, lambda p: p.s < golds[k + 1].e AND golds[k + 1].s < p.e)[1].o AS o FROM fold WHERE k < len(golds))),
folded AS (SELECT * FROM fold WHERE k = len(golds)),
rest AS (
  SELECT {keys}, label, 'g' AS side, unnest(lost).s AS s, unnest(lost).e AS e, unnest(lost).o AS o FROM folded
  UNION ALL SELECT {keys}, label, 'p', unnest(preds).s, unnest(preds).e, unnest(preds).o FROM folded),
late AS (
  SELECT *, row_number() OVER (PARTITION BY {keys}, s, e, side ORDER BY label, o) <= least(count(*) FILTER (side = 'g') OVER m, count(*) FILTER (side = 'p') OVER m) AS taken
  FROM rest WINDOW m AS (PARTITION BY {keys}, s, e)),
outcomes AS (
  SELECT {keys}, label, CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(partial) AS BIGINT) AS partial, CAST(sum(incorrect) AS BIGINT) AS incorrect, CAST(sum(missed) AS BIGINT) AS missed, CAST(sum(spurious) AS BIGINT) AS spurious FROM (
    SELECT {keys}, label, correct, hits AS partial, 0 AS incorrect, 0 AS missed, 0 AS spurious FROM folded JOIN groups USING ({keys}, label)
    UNION ALL SELECT {keys}, label, 0, 0, CAST(side = 'g' AND taken AS INTEGER), CAST(side = 'g' AND NOT taken AS INTEGER), CAST(side = 'p' AND NOT taken AS INTEGER) FROM late)
  GROUP BY ALL)"""


OUTCOMES = _outcomes(PRED, "doc_id, rec")
MARKED = f"{PRED},{_marked('doc_id, rec')}"
SEEDS = _outcomes(
    f"""{PRED.replace('both_ AS', 'all_ AS')}, both_ AS (SELECT * FROM all_, range(3) t(seed) WHERE side = 'g' OR ordinal % (seed + 7) <> 0)""", "seed, doc_id, rec"
)

COUNTS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("correct", "partial", "incorrect", "missed", "spurious"))


def _scored(counts: str, keep: str) -> str:
    """keep, precision, recall, f1 and accuracy of a query of the five counts."""
    return f"""
SELECT {keep}, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1, a AS accuracy FROM (
  SELECT *, CASE WHEN correct + incorrect + partial + spurious > 0 THEN (correct + 0.5 * partial) / CAST(correct + incorrect + partial + spurious AS DOUBLE) ELSE 0.0 END AS p,
    CASE WHEN correct + incorrect + partial + missed > 0 THEN (correct + 0.5 * partial) / CAST(correct + incorrect + partial + missed AS DOUBLE) ELSE 0.0 END AS r,
    CASE WHEN correct + incorrect + partial + missed + spurious > 0 THEN (correct + 0.5 * partial) / CAST(correct + incorrect + partial + missed + spurious AS DOUBLE) ELSE 0.0 END AS a
  FROM ({counts}))"""


def _prf(c: str, p: str, r: str, prefix: str = "") -> str:
    pr, re = f"CASE WHEN {p} > 0 AND {r} > 0 THEN {c} / CAST({p} AS DOUBLE) ELSE 0.0 END", f"CASE WHEN {p} > 0 AND {r} > 0 THEN {c} / CAST({r} AS DOUBLE) ELSE 0.0 END"
    return f"{pr} AS {prefix}precision, {re} AS {prefix}recall, CASE WHEN {c} > 0 THEN 2 * ({pr}) * ({re}) / (({pr}) + ({re})) ELSE 0.0 END AS {prefix}f1"


SPLIT = "CASE WHEN (doc_id * 7) % 10 <= 6 THEN 'train' WHEN (doc_id * 7) % 10 = 7 THEN 'eval' ELSE 'test' END"

SENTENCES = f"""
lines AS (SELECT doc_id, unnest(t) AS text, generate_subscripts(t, 1) - 1 AS sent_idx FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents)),
sentences AS (SELECT doc_id, sent_idx, doc_id || '_' || sent_idx AS id, text, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY sent_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS document_start, {SPLIT} AS split FROM lines),
at_ AS (SELECT doc_id, sent_idx, CAST((doc_id * 7 + sent_idx * 5) % (length(text) - 3) AS INTEGER) AS a FROM sentences WHERE length(text) >= 4),
spans AS (
  SELECT doc_id, sent_idx, a AS s, a + 2 AS e, 'L0' AS tag FROM at_
  UNION ALL SELECT doc_id, sent_idx, a, a + 2, 'L1' FROM at_ WHERE sent_idx % 2 = 0
  UNION ALL SELECT doc_id, sent_idx, a + 1, a + 3, 'L2' FROM at_ WHERE sent_idx % 2 = 0)"""

CUT = rf"""{SENTENCES},
stiles AS (SELECT doc_id, sent_idx, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, sent_idx, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[{SPACE}]+|(?s:.)') AS p FROM sentences)),
soffs AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id, sent_idx ORDER BY i) AS e FROM stiles),
bounds AS (
  SELECT doc_id, sent_idx, e - length(piece) AS b FROM soffs UNION SELECT doc_id, sent_idx, e FROM soffs
  UNION SELECT doc_id, sent_idx, s FROM spans UNION SELECT doc_id, sent_idx, e FROM spans),
chunks AS (SELECT doc_id, sent_idx, b AS s, lead(b) OVER (PARTITION BY doc_id, sent_idx ORDER BY b) AS e FROM bounds),
cut AS (
  SELECT doc_id, sent_idx, CAST(row_number() OVER (PARTITION BY doc_id, sent_idx ORDER BY c.s) - 1 AS INTEGER) AS pos, CAST(c.s AS INTEGER) AS s, CAST(c.e AS INTEGER) AS e, substring(x.text, CAST(c.s AS BIGINT) + 1, CAST(c.e - c.s AS BIGINT)) AS token
  FROM chunks c JOIN sentences x USING (doc_id, sent_idx) WHERE c.e IS NOT NULL AND NOT regexp_full_match(substring(x.text, CAST(c.s AS BIGINT) + 1, CAST(c.e - c.s AS BIGINT)), '[{SPACE}]*'))"""

ALIGNED = f"""{CUT},
fits AS (SELECT p.doc_id, p.sent_idx, p.tag, p.s, p.e, min(c.pos) AS first, max(c.pos) AS last, count(c.pos) AS n, min(c.s) AS lo, max(c.e) AS hi
  FROM spans p LEFT JOIN cut c ON p.doc_id = c.doc_id AND p.sent_idx = c.sent_idx AND c.s >= p.s AND c.e <= p.e GROUP BY ALL)"""


def _bio(limit: int) -> str:
    """Labels of the first limit tokens of each document; mentions cover their own token and perhaps the next."""
    return f"""{GOLD},
bio AS (
  SELECT DISTINCT t.doc_id, t.pos, CASE WHEN t.s > g.s THEN 2 ELSE 1 END + 2 * CAST(g.label[2:] AS INTEGER) AS label_id
  FROM tok t JOIN (SELECT *, unnest([pos, pos + 1]) AS near FROM gold) g ON t.doc_id = g.doc_id AND t.pos = g.near AND t.s >= g.s AND t.e <= g.e WHERE t.pos < {limit})"""


BIO = _bio(MAX_LENGTH)

TAGS = f"tags AS (SELECT 0 AS label_id, 'O' AS tag UNION ALL SELECT 2 * i + 1, 'B-L' || i FROM range({L}) t(i) UNION ALL SELECT 2 * i + 2, 'I-L' || i FROM range({L}) t(i))"

LENGTHS = f"{TOKENS}, lengths AS (SELECT lang, coalesce(c, 0) AS length FROM documents LEFT JOIN (SELECT doc_id, count(*) AS c FROM tok GROUP BY 1) USING (doc_id))"


def _summary(group: str, source: str) -> str:
    p = ", ".join(f"coalesce(CAST(trunc(quantile_cont(length, {q / 100})) AS INTEGER), 0) AS p{q}" for q in (50, 90, 95, 99))
    return f"SELECT {group}, count(length) AS count, coalesce(min(length), 0) AS min, coalesce(max(length), 0) AS max, coalesce(avg(length), 0.0) AS mean, {p} FROM {source} GROUP BY GROUPING SETS (({group}), ())"


STRUCTURE = f"""{GOLD},
sp AS (SELECT doc_id, rec, s, e, count(DISTINCT label) > 1 AS same_span FROM gold GROUP BY ALL),
inner_ AS (SELECT DISTINCT a.doc_id, a.rec, a.s, a.e FROM sp a JOIN sp b ON a.doc_id = b.doc_id AND a.rec = b.rec AND b.s <= a.s AND b.e >= a.e AND (b.s < a.s OR b.e > a.e)),
structured AS (SELECT g.*, same_span, i.s IS NOT NULL AS nested, NOT same_span AND i.s IS NULL AS flat, {SPLIT.replace('doc_id', 'g.doc_id')} AS split
  FROM gold g JOIN sp USING (doc_id, rec, s, e) LEFT JOIN inner_ i USING (doc_id, rec, s, e))"""

TABLE = f"""{GOLD}, pivoted AS (SELECT label, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'eval') AS eval, count(*) FILTER (split = 'test') AS test FROM (SELECT label, {SPLIT} AS split FROM gold) GROUP BY 1),
label_table AS (SELECT *, least(train, eval, test) AS minimum FROM pivoted)"""

TWICE = f"SELECT doc_id, {SPLIT} AS split FROM documents UNION ALL SELECT doc_id, 'test' FROM documents WHERE doc_id % 4 = 0"

TOXIC = "toxic AS (SELECT doc_id FROM labels WHERE toxic = 1)"

RECORDS = f"""{TOKENS}, {TOXIC},
rec0 AS (
  SELECT d.doc_id, d.text AS full_text, x.doc_id IS NOT NULL AS out, x.doc_id IS NOT NULL AND d.doc_id % 17 <> 0 AS hidden FROM documents d LEFT JOIN toxic x USING (doc_id)),
records AS (
  SELECT *, doc_id || '_0' AS id, CASE WHEN NOT hidden THEN full_text END AS text, sha256(CASE WHEN doc_id % 23 = 0 THEN full_text || 'x' ELSE full_text END) AS text_sha256,
    length(full_text) + CASE WHEN doc_id % 31 = 0 THEN 1 ELSE 0 END AS text_length, {SPLIT} AS split FROM rec0),
ents AS (SELECT t.doc_id, pos, s, e + CASE WHEN t.doc_id % 19 = 0 THEN 100000 ELSE 0 END AS e, CASE WHEN NOT hidden THEN CASE WHEN t.doc_id % 29 = 0 THEN token || '?' ELSE token END END AS etext FROM tok t JOIN records r USING (doc_id) WHERE pos % 3 = 0),
errors AS (
  SELECT id, split, 'text is not reconstructed' AS error FROM records WHERE text IS NULL
  UNION ALL SELECT id, split, 'text_sha256 mismatch' FROM records WHERE text IS NOT NULL AND text_sha256 <> sha256(text)
  UNION ALL SELECT id, split, 'text_length mismatch' FROM records WHERE text IS NOT NULL AND text_length <> length(text)
  UNION ALL SELECT id, split, CASE WHEN s < 0 OR e > length(text) OR s > e THEN 'invalid entity offsets' ELSE 'entity text mismatch' END FROM ents JOIN records USING (doc_id)
    WHERE text IS NOT NULL AND (s < 0 OR e > length(text) OR s > e OR etext <> substring(text, s + 1, e - s))),
leaks AS (
  SELECT id, CAST(doc_id AS VARCHAR) AS doc_id, 'missing excluded status' AS error FROM records WHERE out AND doc_id % 3 = 0 AND doc_id % 34 = 0
  UNION ALL SELECT id, CAST(doc_id AS VARCHAR), e FROM (SELECT id, doc_id, unnest(['contains sentence text', 'retains brat_txt_path', 'retains brat_ann_path']) AS e FROM records WHERE out AND NOT hidden)
  UNION ALL SELECT id, CAST(doc_id AS VARCHAR), 'contains entity text' FROM ents JOIN records USING (doc_id) WHERE out AND etext IS NOT NULL),
leaked_files AS (SELECT 'x/0text' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.txt' ELSE '.ann' END AS path, CAST(doc_id AS VARCHAR) AS doc_id, 'file of a text-excluded document' AS error FROM documents SEMI JOIN toxic USING (doc_id))"""


def _blank(k: int, text: str) -> str:
    return f"CASE WHEN doc_id % {k} = 0 THEN '' ELSE {text} END"


AUDIT = f"""{TOXIC},
audit AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, {SPLIT} AS split, '0text' || doc_id || '.txt' AS source_file, CASE WHEN t.doc_id IS NOT NULL THEN 'exclude_text' ELSE 'include_text' END AS source_text_decision,
    'Title ' || doc_id AS source_title, {_blank(7, "'10.1000/' || doc_id")} AS doi, {_blank(3, "CAST(doc_id AS VARCHAR)")} AS pmid, {_blank(5, "'PMC' || doc_id")} AS pmcid,
    CAST(1990 + doc_id % 35 AS VARCHAR) AS publication_year, source AS journal, '' AS publisher,
    coalesce(nullif({_blank(2, "'cc by'")}, ''), nullif({_blank(4, "'cc-by-nc'")}, ''), nullif({_blank(8, "'bronze'")}, ''), {_blank(16, "'https://creativecommons.org/licenses/by/4.0/'")}) AS license_evidence,
    CASE WHEN doc_id % 4 = 1 THEN 'high' ELSE 'low' END AS match_confidence, 'rule ' || (doc_id % 6) AS match_reason, sha256(text) AS normalized_document_sha256
  FROM (SELECT d.*, x.doc_id AS out FROM documents d LEFT JOIN toxic x USING (doc_id)) AS d)""".replace("t.doc_id IS NOT NULL", "out IS NOT NULL")

MAPPING = """mapping AS (
  SELECT min(p_partkey) AS row_no, p_type AS source_type, CASE WHEN min(p_size) % 10 = 9 THEN '0.0' ELSE 'L' || (min(p_size) % 5) END AS target_label FROM part GROUP BY 2
  UNION ALL SELECT * FROM (VALUES (-3, 'Acid, Nucleic-Type', 'L1'), (-2, 'Body_Part', 'L9'), (-1, 'Cell Line', '0.0')))"""

GRID = """grid AS (SELECT doc_id, r AS row_, c AS col_, ch AS channel, ((doc_id * 31 + r * 17 + c * 13 + ch * 7) % 100) / 100 AS score FROM documents, range(8) a(r), range(8) b(c), range(1, 4) x(ch))"""
GRID_GOLD = """gg AS (SELECT doc_id, [doc_id % 6, doc_id % 6 + 1] AS index, 2 AS type FROM documents UNION ALL SELECT doc_id, [doc_id % 6], 3 FROM documents)"""


def _cells(first: tuple, second: tuple, names: tuple[str, str]) -> str:
    listed = lambda values: "[" + ", ".join(f"{v}::DOUBLE" for v in values) + "]"
    return f"SELECT CAST(row_number() OVER (ORDER BY a, b) - 1 AS INTEGER) AS cell, a AS {names[0]}, b AS {names[1]} FROM (SELECT unnest({listed(first)}) AS a), (SELECT unnest({listed(second)}) AS b)"


def _decoded(cells: str) -> str:
    """Chains under the thresholds of each cell."""
    return f"""RECURSIVE {GRID}, {GRID_GOLD}, cells AS ({cells}),
marks AS (SELECT cell, doc_id, row_ AS tail, col_ AS head, channel AS type FROM grid, cells WHERE channel > 1 AND score > head_threshold AND col_ <= row_),
links AS (SELECT cell, doc_id, row_ AS a, col_ AS b FROM grid, cells WHERE channel = 1 AND score > next_threshold AND row_ < col_),
chain(cell, doc_id, tail, type, index) AS (
  SELECT cell, doc_id, tail, type, [head] FROM marks
  UNION ALL SELECT c.cell, c.doc_id, tail, type, list_append(index, l.b) FROM chain c JOIN links l ON c.cell = l.cell AND c.doc_id = l.doc_id AND l.a = c.index[-1] AND l.b <= c.tail),
entities AS (SELECT DISTINCT cell, doc_id, index, type FROM chain WHERE index[-1] = tail)"""


ONE_CELL = "SELECT 0 AS cell, 0.7::DOUBLE AS next_threshold, 0.7::DOUBLE AS head_threshold"
GRID_CELLS = _cells(NEXT_GRID, HEAD_GRID, ("next_threshold", "head_threshold"))
FLAT_CELLS = _cells(LOGIT_GRID, PROB_GRID, ("logit_threshold", "prob_threshold"))
FIVE = ("correct", "partial", "incorrect", "missed", "spurious")
PER_CELL = f"per AS (SELECT cell, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in FIVE)} FROM outcomes GROUP BY 1)"
ALL_CELLS = f"SELECT cells.*, {', '.join(f'coalesce({c}, 0) AS {c}' for c in FIVE)} FROM cells LEFT JOIN per USING (cell)"

SWEPT = _outcomes(
    f"""{_decoded(GRID_CELLS)},
found AS (SELECT cell, gg.doc_id, index, type, 'g' AS side FROM gg, cells UNION ALL SELECT cell, doc_id, index, type, 'p' FROM entities),
both_ AS (SELECT cell, doc_id, index[1] AS s, index[-1] + 1 AS e, CAST(type AS VARCHAR) AS label, row_number() OVER (PARTITION BY cell, doc_id, side ORDER BY index, type) AS ordinal, side FROM found)""",
    "cell, doc_id",
)
SWEEP = f"""{SWEPT}, {PER_CELL},
same AS (SELECT cell, count(*) FILTER (n = 2) AS same_entities, count(*) FILTER (n = 2 OR one = 'p') AS predicted, count(*) FILTER (n = 2 OR one = 'g') AS relevant
  FROM (SELECT cell, doc_id, index, type, count(*) AS n, min(side) AS one FROM found GROUP BY ALL) GROUP BY 1)"""
SWEEP_ROWS = _scored(f"{ALL_CELLS.replace('SELECT cells.*', 'SELECT cells.*, same_entities, predicted, relevant')} LEFT JOIN same USING (cell)", f"cell, next_threshold, head_threshold, {', '.join(FIVE)}, same_entities, predicted, relevant")

FLAT = _outcomes(
    f"""cells AS ({FLAT_CELLS}), places AS (SELECT doc_id, o FROM documents, range(8) t(o)),
fg AS (SELECT doc_id, o, o * 4 AS s, o * 4 + 3 AS e, 'L' || ((doc_id + o) % 3) AS label FROM places WHERE (doc_id + o) % 4 <> 0),
fp AS (SELECT doc_id, o, o * 4 AS s, o * 4 + 3 - (doc_id + o) % 2 AS e, 'L' || ((doc_id + o + CASE WHEN (doc_id * 3 + o) % 5 = 0 THEN 1 ELSE 0 END) % 3) AS label, ((doc_id * 29 + o * 41) % 100) / 100 AS logit, ((doc_id * 17 + o * 23) % 100) / 100 AS prob FROM places),
both_ AS (SELECT cell, doc_id, s, e, label, o AS ordinal, 'g' AS side FROM fg, cells UNION ALL SELECT cell, doc_id, s, e, label, o, 'p' FROM fp, cells WHERE logit > logit_threshold AND prob > prob_threshold)""",
    "cell, doc_id",
)
FLAT_ROWS = _scored(ALL_CELLS, f"cell, logit_threshold, prob_threshold, {', '.join(FIVE)}")
BEST = "ORDER BY f1 DESC, precision DESC, recall DESC, cell LIMIT 1"

ORACLES: dict[str, str] = {
    "tokens_with_offsets": f'WITH {TOKENS} SELECT doc_id, pos, s AS start, e AS "end", token FROM plain',
    "tokens_cut_at_tags": f'WITH {CUT} SELECT doc_id, sent_idx, pos, s AS start, e AS "end", token FROM cut',
    "span_alignment": f'WITH {ALIGNED} SELECT doc_id, sent_idx, tag, s AS start, e AS "end", first, last, n AS n_tokens, coalesce(lo = s AND hi = e, false) AS aligned FROM fits',
    "converted_records": f"""WITH {ALIGNED}, t AS (SELECT doc_id, sent_idx, CAST(count(*) AS INTEGER) AS n_tokens, sha256(string_agg(token, ' ' ORDER BY pos)) AS tokens_sha256 FROM cut GROUP BY 1, 2),
        m AS (SELECT doc_id, sent_idx, string_agg(array_to_string(range(first, last + 1), '-') || ':' || tag, ' ' ORDER BY s, e, tag) AS mentions FROM fits WHERE lo = s AND hi = e GROUP BY 1, 2)
        SELECT doc_id, sent_idx, n_tokens, tokens_sha256, coalesce(mentions, '') AS mentions FROM t LEFT JOIN m USING (doc_id, sent_idx)""",
    "conversion_stats": f"""WITH {SENTENCES}, g AS (SELECT doc_id, sent_idx, s, e, count(*) AS n FROM spans GROUP BY ALL)
        SELECT (SELECT count(*) FROM sentences) AS sentences, CAST(sum(n) AS BIGINT) AS entities, count(DISTINCT CASE WHEN n > 1 THEN (doc_id, sent_idx) END) AS sentences_with_same_span_multilabel, count(*) FILTER (n > 1) AS same_span_groups, CAST(sum(n - 1) AS BIGINT) AS same_span_extra_labels FROM g""",
    "bio_labels": f"WITH {BIO} SELECT * FROM bio",
    "bio_tag_inventory": """WITH l AS (SELECT CAST(row_number() OVER (ORDER BY p_type) - 1 AS INTEGER) AS i, p_type FROM (SELECT DISTINCT p_type FROM part))
        SELECT 0 AS label_id, 'O' AS tag UNION ALL SELECT 2 * i + 1, 'B-' || p_type FROM l UNION ALL SELECT 2 * i + 2, 'I-' || p_type FROM l""",
    "positive_weights": f"""WITH {BIO}, {TAGS}, n AS (SELECT count(*) AS n FROM tok WHERE pos < {MAX_LENGTH}), c AS (SELECT label_id, count(*) AS p FROM bio GROUP BY 1)
        SELECT label_id, tag, coalesce(p, 0) AS positives, CASE WHEN label_id > 0 AND p > 0 THEN greatest(1.0, least(50.0, (n - p) / CAST(p AS DOUBLE))) ELSE 1.0 END AS weight FROM tags LEFT JOIN c USING (label_id), n""",
    "padded_labels": f"""WITH {BIO}, sizes AS (SELECT doc_id, least(count(*), {MAX_LENGTH}) AS n FROM tok GROUP BY 1),
        d AS (SELECT doc_id, n, (SELECT min(x) FROM (SELECT unnest({list(PADDED)}) AS x) WHERE x >= n) AS padded_to FROM sizes),
        l AS (SELECT doc_id, pos, sum(1 << label_id) AS bits FROM bio GROUP BY 1, 2)
        SELECT p.doc_id, CAST(padded_to AS INTEGER) AS padded_to, CAST(n AS INTEGER) AS real, md5(string_agg(CAST(coalesce(bits, 0) AS VARCHAR), ',' ORDER BY i)) AS bits_md5
        FROM (SELECT *, unnest(range(padded_to)) AS i FROM d) p LEFT JOIN l ON p.doc_id = l.doc_id AND p.i = l.pos GROUP BY ALL""",
    "subword_tokens": """SELECT doc_id, CAST(i AS INTEGER) AS pos, CAST(i * 4 AS INTEGER) AS start, CAST(least(i * 4 + 4, length(text)) AS INTEGER) AS "end", substring(text, i * 4 + 1, 4) AS token FROM (SELECT doc_id, text, unnest(range((length(text) + 3) // 4)) AS i FROM documents)""",
    "token_length_summary": f"WITH {LENGTHS} {_summary('lang', 'lengths')}",
    "token_length_coverage": f"WITH {LENGTHS} SELECT lang, threshold, avg(CAST(length <= threshold AS DOUBLE)) AS coverage FROM lengths, (SELECT unnest({list(COVERAGE)}) AS threshold) GROUP BY GROUPING SETS ((lang, threshold), (threshold))",
    "document_names": r"""SELECT doc_id, nullif(regexp_extract(n, 'text(\d+)\.(?:txt|ann)$', 1), '') AS from_name, nullif(regexp_extract(n, 'text(\d+)\.txt', 1), '') AS in_text_name,
        CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE 'm' || doc_id END AS record_doc_id FROM (SELECT doc_id, '0text' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.ann' ELSE '.md' END AS n FROM documents)""",
    "text_digests_and_slices": "SELECT doc_id, sha256(text) AS text_sha256, substring(text, length(text) // 2 + 1, 9) AS piece, sha256(substring(text, length(text) // 2 + 1) || ' ' || substring(text, 1, length(text) // 3)) AS joined_sha256 FROM documents",
    "tags_as_entities": f'WITH {SENTENCES} SELECT doc_id, sent_idx, s AS start, e AS "end", tag AS label FROM spans',
    "index_codec": "SELECT doc_id, array_to_string(range(0, doc_id % 5 + 1), '-') || '-#-' || (doc_id % 3 + 2) AS packed, array_to_string(range(0, doc_id % 5 + 1), ',') AS index_list, CAST(doc_id % 3 + 2 AS INTEGER) AS type FROM documents",
    "token_roles": f"""WITH {TOKENS} SELECT doc_id, ss, se, CASE WHEN e <= s THEN 'N' WHEN s < ss OR e > se THEN 'O' WHEN s > ss THEN 'I' ELSE 'B' END AS role, count(*) AS n FROM tok, (VALUES (0, 5), (2, 400), (100, 100000)) x(ss, se) GROUP BY ALL""",
    "number_lists": "SELECT doc_id, 0 AS at, CAST(0.5 AS DOUBLE) AS number FROM documents UNION ALL SELECT doc_id, 1, CAST(doc_id % 7 AS DOUBLE) FROM documents",
    "plain_names": f"WITH {MAPPING} SELECT source_type, replace(translate(replace(source_type, ',', ''), '_-', '  '), ' ', '') AS plain FROM mapping",
    "f1_of_counts": f"SELECT doc_id, {_prf('(doc_id % 5)', '(doc_id % 7)', '(doc_id % 11)').replace('WHEN (doc_id % 5) > 0 THEN 2', 'WHEN (doc_id % 5) > 0 AND (doc_id % 7) > 0 AND (doc_id % 11) > 0 THEN 2')} FROM documents",
    "exact_matches": f"WITH {MARKED} SELECT label, side, count(*) FILTER (exact) AS matched, count(*) AS mentions FROM marked GROUP BY ALL",
    "match_outcomes": f"WITH {OUTCOMES} SELECT * FROM outcomes",
    "score_overlap_per_label": f"WITH {OUTCOMES} {_scored(f'SELECT label, {COUNTS} FROM outcomes GROUP BY GROUPING SETS ((label), ())', 'label, correct, partial, incorrect, missed, spurious')}",
    "score_exact": f"""WITH {MARKED}, per AS (SELECT label, count(*) FILTER (side = 'g' AND exact) AS c, count(*) FILTER (side = 'p') AS p, count(*) FILTER (side = 'g') AS r FROM marked GROUP BY 1),
        s AS (SELECT c, p, r, {_prf('c', 'p', 'r')} FROM per), t AS (SELECT sum(c) AS c, sum(p) AS p, sum(r) AS r, avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1 FROM s)
        SELECT {_prf('c', 'p', 'r', 'micro_')}, macro_precision, macro_recall, macro_f1 FROM t""",
    "structural_recovery": f"""WITH {MARKED}, {STRUCTURE.removeprefix(GOLD)[1:]}, k AS (SELECT doc_id, rec, ordinal, unnest(list_filter([CASE WHEN flat THEN 'flat' END, CASE WHEN nested THEN 'nested' END, CASE WHEN same_span THEN 'same_span' END], lambda x: x IS NOT NULL)) AS kind FROM structured)
        SELECT kind, count(*) AS mentions, count(*) FILTER (exact) AS matched, avg(CAST(exact AS DOUBLE)) AS share FROM k JOIN marked m ON m.side = 'g' AND k.doc_id = m.doc_id AND k.rec = m.rec AND k.ordinal = m.ordinal GROUP BY 1""",
    "scores_over_seeds": f"""WITH {SEEDS}, sc AS ({_scored(f'SELECT seed, {COUNTS} FROM outcomes GROUP BY 1', 'seed')})
        SELECT 'overlap' AS metric, {', '.join(f'avg({m}) AS {m}_mean, stddev_pop({m}) AS {m}_std' for m in ('precision', 'recall', 'f1', 'accuracy'))} FROM sc""",
    "positional_alignment": "SELECT doc_id AS record_no, lang, quality FROM documents JOIN labels USING (doc_id)",
    "unaligned_records": "SELECT coalesce(d.doc_id, l.k) AS record_no, d.doc_id IS NOT NULL AS in_gold, l.k IS NOT NULL AS in_pred FROM documents d FULL JOIN (SELECT doc_id + 1 AS k FROM labels) l ON d.doc_id = l.k WHERE d.doc_id IS NULL OR l.k IS NULL",
    "masked_loss": """SELECT sum(loss * mask) / greatest(sum(mask), 1.0) AS loss FROM (SELECT CAST(doc_id % 5 <> 0 AS INTEGER) AS mask, (1 + doc_id % 3) * y * ln(1 + exp(-x)) + (1 - y) * ln(1 + exp(x)) AS loss FROM (SELECT doc_id, CAST(doc_id % 9 - 4 AS DOUBLE) AS x, doc_id % 2 AS y FROM documents))""",
    "mention_structure": f"WITH {STRUCTURE} SELECT doc_id, count(*) AS mentions, count(*) FILTER (same_span) AS same_span, count(*) FILTER (nested) AS nested, count(*) FILTER (flat) AS flat FROM structured GROUP BY 1",
    "rows_per_document": f"WITH {SENTENCES} SELECT doc_id, count(*) AS sentence_count FROM sentences GROUP BY 1",
    "label_split_table": f"WITH {TABLE} SELECT * FROM label_table",
    "rare_labels": f"WITH {TABLE} SELECT label, minimum FROM label_table QUALIFY minimum < avg(minimum) OVER ()",
    "median_of_label_minima": f"WITH {TABLE} SELECT min(minimum) AS lowest, quantile_cont(minimum, 0.5) AS median FROM label_table",
    "split_totals": f"""WITH {STRUCTURE}, r AS (SELECT DISTINCT doc_id, rec, {SPLIT} AS split FROM tok), a AS (SELECT split, count(DISTINCT doc_id) AS documents, count(*) AS sentences FROM r GROUP BY 1),
        b AS (SELECT split, CAST(sum(n) AS BIGINT) AS entities, count(*) FILTER (s) AS same_span_sentences, count(*) FILTER (d) AS nested_sentences FROM (SELECT split, doc_id, rec, count(*) AS n, bool_or(same_span) AS s, bool_or(nested) AS d FROM structured GROUP BY ALL) GROUP BY 1),
        c AS (SELECT split, count(DISTINCT label) AS labels FROM structured GROUP BY 1)
        SELECT * FROM a LEFT JOIN b USING (split) LEFT JOIN c USING (split)""",
    "split_combinations": f"SELECT combination, count(*) AS n FROM (SELECT doc_id, string_agg(DISTINCT split, '+' ORDER BY split) AS combination FROM ({TWICE}) GROUP BY 1) GROUP BY 1",
    "split_overlaps": f"SELECT doc_id, count(DISTINCT split) AS n_splits FROM ({TWICE}) GROUP BY 1 HAVING count(DISTINCT split) > 1",
    "missing_split_labels": f"""WITH {GOLD}, m AS (SELECT DISTINCT label, {SPLIT} AS split FROM gold), wanted AS (SELECT split, label FROM (VALUES ('train'), ('eval'), ('test')) s(split), (SELECT 'L' || i AS label FROM range({L + 1}) t(i)))
        SELECT split, label FROM wanted ANTI JOIN (SELECT * FROM m WHERE label <> 'L3' OR split <> 'eval') x USING (split, label)""",
    "split_search": f"""WITH {STRUCTURE}, per AS (SELECT doc_id, rec, bool_or(nested) AS d, bool_or(same_span) AS s FROM structured GROUP BY 1, 2), labels_ AS (SELECT DISTINCT doc_id, label FROM structured),
        d AS (SELECT doc_id, count(*) AS sentences, count(*) FILTER (d) AS nested, count(*) FILTER (s) AS same_span FROM per GROUP BY 1),
        g AS (SELECT c AS candidate, d.*, sum(sentences) OVER (PARTITION BY c ORDER BY (doc_id * (2 * c + 1) * 7919 + c * 104729) % 1000003, doc_id) - sentences AS upto, sum(sentences) OVER (PARTITION BY c) AS whole FROM range({CANDIDATES}) t(c), d),
        p AS (SELECT *, CASE WHEN upto < 0.7 * whole THEN 'train' WHEN upto < (0.7::DOUBLE + 0.1::DOUBLE) * whole THEN 'eval' ELSE 'test' END AS split FROM g),
        s AS (SELECT candidate, split, sum(sentences) AS a, sum(nested) AS b, sum(same_span) AS c FROM p GROUP BY ALL),
        o AS (SELECT candidate, sum(off) AS off FROM (SELECT candidate, abs(a / CAST(greatest(sum(a) OVER w, 1) AS DOUBLE) - goal) + abs(b / CAST(greatest(sum(b) OVER w, 1) AS DOUBLE) - goal) + abs(c / CAST(greatest(sum(c) OVER w, 1) AS DOUBLE) - goal) AS off
            FROM (SELECT *, CASE split WHEN 'train' THEN 0.7 WHEN 'eval' THEN 0.1 ELSE 0.2 END AS goal FROM s) WINDOW w AS (PARTITION BY candidate)) GROUP BY 1),
        h AS (SELECT candidate, count(DISTINCT (split, label)) AS have FROM p JOIN labels_ USING (doc_id) GROUP BY 1),
        b AS (SELECT candidate, off + (SELECT count(DISTINCT label) FROM labels_) * 3 - have AS score FROM o JOIN h USING (candidate) ORDER BY round(off + (SELECT count(DISTINCT label) FROM labels_) * 3 - have, 9), candidate LIMIT 1)
        SELECT CAST(candidate AS INTEGER) AS candidate, doc_id, split, round(score, 6) AS score FROM p JOIN b USING (candidate)""",
    "document_offsets": f"WITH {SENTENCES} SELECT doc_id, sent_idx, tag, s + document_start AS document_from, e + document_start AS document_to FROM spans JOIN sentences USING (doc_id, sent_idx)",
    "reconstruction_sources": f"""WITH {SENTENCES}, {AUDIT}, c AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, count(*) AS n FROM sentences WHERE doc_id % 10 <> 3 GROUP BY 1),
        u AS (SELECT *, CASE WHEN doi <> '' THEN 'https://doi.org/' || doi ELSE '' END AS doi_url, CASE WHEN pmid <> '' THEN 'https://pubmed.ncbi.nlm.nih.gov/' || pmid || '/' ELSE '' END AS pubmed_url,
            CASE WHEN pmcid <> '' THEN 'https://www.ncbi.nlm.nih.gov/pmc/articles/' || pmcid || '/' ELSE '' END AS pmc_url,
            CASE WHEN pmid <> '' THEN 'https://europepmc.org/article/MED/' || pmid WHEN pmcid <> '' THEN 'https://europepmc.org/article/PMC/' || regexp_replace(pmcid, '^PMC', '') WHEN doi <> '' THEN 'https://europepmc.org/search?query=DOI:' || doi ELSE '' END AS europe_pmc_url FROM audit)
        SELECT u.*, coalesce(nullif(doi_url, ''), nullif(pmc_url, ''), pubmed_url) AS source_url, coalesce(n, 0) AS sentence_count, CASE WHEN source_text_decision = 'include_text' THEN '{INCLUDED}' ELSE '{EXCLUDED}' END AS reconstruction_note FROM u LEFT JOIN c USING (doc_id)""",
    "licence_decisions": f"WITH {AUDIT} SELECT doc_id, license_evidence AS evidence, CASE WHEN license_evidence IN ('cc by', 'https://creativecommons.org/licenses/by/4.0/') THEN 'include_text' ELSE 'exclude_text' END AS decision FROM audit",
    "audit_frequencies": f"WITH {AUDIT} SELECT 'source_text_decision' AS what, source_text_decision AS value, count(*) AS n FROM audit GROUP BY ALL UNION ALL SELECT 'match_confidence', match_confidence, count(*) FROM audit GROUP BY ALL UNION ALL SELECT 'match_reason', match_reason, count(*) FROM audit GROUP BY ALL",
    "mapped_labels": f"WITH {MAPPING} SELECT p_partkey, p_type AS source_type, target_label AS label FROM part JOIN mapping ON p_type = source_type WHERE target_label <> '0.0'",
    "mapping_report": f"""WITH {MAPPING}, a AS (SELECT 'L' || i AS label FROM range({L}) t(i)), t AS (SELECT DISTINCT target_label AS label FROM mapping WHERE target_label <> '0.0'), k AS (SELECT DISTINCT p_type AS name FROM part UNION ALL SELECT 'Acid Nucleic Type' UNION ALL SELECT 'Cell-Line')
        SELECT 'invalid_target' AS kind, label AS name FROM t ANTI JOIN a USING (label) UNION ALL SELECT 'unused_label', label FROM a ANTI JOIN t USING (label)
        UNION ALL SELECT 'unmatched_type', source_type FROM mapping WHERE replace(translate(replace(source_type, ',', ''), '_-', '  '), ' ', '') NOT IN (SELECT replace(name, ' ', '') FROM k)""",
    "mapping_totals": f"WITH {MAPPING} SELECT count(*) AS mapping_rows, count(DISTINCT source_type) AS source_types, count(*) FILTER (target_label = '0.0') AS drop_rows, count(DISTINCT target_label) FILTER (target_label <> '0.0') AS kept_labels FROM mapping",
    "top_mapping_targets": f"WITH {MAPPING} SELECT target_label, count(*) AS n, min(row_no) AS first FROM mapping GROUP BY 1 ORDER BY n DESC, first LIMIT 20",
    "record_errors": f"WITH {RECORDS} SELECT id, error FROM errors",
    "validation_totals": f"WITH {RECORDS} SELECT error, count(*) AS n FROM (SELECT * FROM errors UNION ALL SELECT * FROM errors WHERE split = 'test') GROUP BY 1",
    "leak_errors": f"WITH {RECORDS} SELECT * FROM leaks",
    "excluded_files": f"WITH {RECORDS} SELECT * FROM leaked_files",
    "leakage_report": f"WITH {RECORDS} SELECT id AS place, error FROM leaks UNION ALL SELECT path, error FROM leaked_files",
    "redacted_records": f"""WITH {RECORDS}, n AS (SELECT doc_id, count(*) AS n, count(etext) AS t FROM ents GROUP BY 1) SELECT id, out AS hidden, CAST(CASE WHEN out THEN 0 ELSE coalesce(t, 0) END AS INTEGER) AS entity_texts, CAST(coalesce(n, 0) AS INTEGER) AS entities FROM records LEFT JOIN n USING (doc_id)""",
    "checksum_errors": """SELECT 'f' || doc_id || '.txt' AS path, CASE WHEN doc_id % 13 = 0 THEN 'missing' WHEN doc_id % 11 = 0 THEN 'not listed' ELSE 'mismatch' END AS error FROM documents
        WHERE NOT (doc_id % 13 = 0 AND doc_id % 11 = 0) AND (doc_id % 13 = 0 OR doc_id % 11 = 0 OR doc_id % 7 = 0)""",
    "excluded_members": f"WITH {TOXIC} SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang FROM documents SEMI JOIN toxic USING (doc_id)",
    "files_of_splits": f"SELECT doc_id, '0text' || doc_id || '.txt' AS file, split FROM (SELECT doc_id, {SPLIT} AS split FROM documents UNION ALL SELECT doc_id, 'extra' FROM documents WHERE doc_id % 4 = 0)",
    "copied_per_split": f"SELECT split, count(*) AS copied FROM (SELECT doc_id, {SPLIT} AS split FROM documents UNION ALL SELECT doc_id, 'extra' FROM documents WHERE doc_id % 4 = 0) GROUP BY 1",
    "annotation_siblings": "SELECT '0text' || d.doc_id AS stem, l.doc_id IS NOT NULL AS has_ann FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "distinct_documents": "SELECT DISTINCT CAST(doc_id AS VARCHAR) AS doc_id FROM documents",
    "sorted_report": "SELECT DISTINCT source FROM documents ORDER BY source LIMIT 20",
    "label_sets": "SELECT 'unused' AS kind, 'L2' AS label UNION ALL SELECT 'used', 'L' || i FROM range(5) t(i) WHERE i <> 2",
    "pooled_lengths": f"WITH l AS (SELECT 'documents' AS file, length(text) AS length FROM documents UNION ALL SELECT 'benchmark', length(text) FROM benchmark) {_summary('file', 'l')}",
    "grid_entities": f"WITH {_decoded(ONE_CELL)} SELECT doc_id, array_to_string(index, '-') || '-#-' || type AS entity FROM entities",
    "grid_entity_counts": f"""WITH {_decoded(ONE_CELL)}, t AS (SELECT (SELECT count(*) FROM entities e JOIN gg g ON e.doc_id = g.doc_id AND e.index = g.index AND e.type = g.type) AS correct, (SELECT count(*) FROM entities) AS predicted, (SELECT count(*) FROM gg) AS relevant)
        SELECT *, {_prf('correct', 'predicted', 'relevant')} FROM t""",
    "threshold_grid": f"""WITH {GRID}, t AS (SELECT DISTINCT CAST(floor(round(score * 100) / 10) AS INTEGER) AS t FROM grid)
        SELECT CAST(row_number() OVER (ORDER BY a.t, b.t) - 1 AS INTEGER) AS cell, a.t / 10.0::DOUBLE AS next_threshold, b.t / 10.0::DOUBLE AS head_threshold FROM t a, t b WHERE a.t % 5 = 0""",
    "threshold_sweep": f"WITH {SWEEP} {SWEEP_ROWS}",
    "best_threshold": f"WITH {SWEEP} {SWEEP_ROWS} {BEST}",
    "flat_sweep": f"WITH {FLAT}, {PER_CELL} {FLAT_ROWS}",
    "best_flat_threshold": f"WITH {FLAT}, {PER_CELL} {FLAT_ROWS} {BEST}",
}

STANDOFF = f"""WITH t AS (SELECT item_id, unnest(w) AS surface, generate_subscripts(w, 1) AS i FROM (SELECT item_id, string_split(translate(text, chr(10) || chr(9) || chr(13), '   '), ' ') AS w FROM benchmark)),
        o AS (SELECT *, CAST(sum(length(surface) + 1) OVER (PARTITION BY item_id ORDER BY i) AS INTEGER) - 1 AS e FROM t)
        SELECT CAST(item_id AS VARCHAR) AS doc_id, '0' AS prefix, 'T' || i AS ann_id, 'L' || (i % {L}) AS label, CAST(e - length(surface) AS INTEGER) AS start, e AS "end", surface FROM o WHERE surface <> ''"""
RECON = ORACLES["reconstruction_sources"]
ORACLES |= {
    "read_strict_jsonl": "SELECT row_number() OVER (ORDER BY item_id) - 1 AS record_no, item_id, sha256(text) AS text_sha256 FROM (SELECT doc_id AS item_id, text FROM documents)",
    "read_lenient_jsonl": "SELECT item_id, sha256(text) AS text_sha256 FROM (SELECT doc_id AS item_id, text FROM documents)",
    "read_json_dataset": "SELECT item_id, length(text) AS n FROM (SELECT doc_id AS item_id, text FROM documents)",
    "read_json_records": "SELECT CAST(2 * row_number() OVER (ORDER BY item_id) AS INTEGER) AS line_num, 'items.jsonl' AS file, item_id FROM (SELECT doc_id AS item_id, text FROM documents) UNION ALL SELECT CAST(row_number() OVER (ORDER BY item_id) AS INTEGER), 'devData.json', item_id FROM (SELECT doc_id AS item_id, text FROM documents)",
    "read_split_ids": "SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM documents WHERE doc_id % 10 IN (0, 4, 5, 8)",
    "read_labels": "SELECT CAST(row_number() OVER (ORDER BY r_regionkey DESC) - 1 AS INTEGER) AS label_id, r_name AS label FROM region",
    "read_reconstruction_tsv": f"SELECT coalesce(CAST(COLUMNS(*) AS VARCHAR), '') FROM ({RECON})",
    "read_label_metrics_csv": f"SELECT coalesce(label, '') AS label, correct, round(f1, 9) AS f1 FROM ({ORACLES['score_overlap_per_label']})",
    "read_workbook": f"WITH {MAPPING} SELECT CAST(row_number() OVER (ORDER BY row_no) AS INTEGER) AS row_no, source_type, target_label FROM mapping",
    "read_standoff": STANDOFF,
    "standoff_format": STANDOFF,
    "stream_standoff": f"SELECT doc_id, label, count(*) AS n FROM ({STANDOFF}) GROUP BY 1, 2",
    "workbooks_of_a_folder": "SELECT r_name || '.xlsx' AS file, CAST(row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS INTEGER) AS row_no, n_name AS source_type, 'L' || n_nationkey AS target_label FROM nation JOIN region ON n_regionkey = r_regionkey",
    "aligned_files": "SELECT record_no, item_id, p.doc_id, quality FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS record_no, doc_id AS item_id FROM documents) g JOIN (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS record_no, doc_id, quality FROM labels) p USING (record_no)",
    "stream_leak_errors": f"WITH {RECORDS} SELECT id, error FROM leaks",
    "seeded_draws": "SELECT CAST(seed AS INTEGER) AS seed, count(*) AS documents, count(*) AS same, CAST(0 AS BIGINT) AS outside FROM documents, range(3) t(seed) GROUP BY 1",
    "sentence_offsets": f"""WITH {GOLD}, {SENTENCES} SELECT g.doc_id, g.s AS start, g.e AS "end", g.label, g.ordinal, x.sent_idx, CAST(greatest(g.s, document_start) - document_start AS INTEGER) AS sentence_from, CAST(least(g.e, document_start + length(text)) - document_start AS INTEGER) AS sentence_to, g.s >= document_start AND g.e <= document_start + length(text) AS whole
        FROM gold g JOIN sentences x ON g.doc_id = x.doc_id AND g.s < document_start + length(text) AND document_start < g.e""",
    "discovered_files": "SELECT '0text' || item_id || '.txt' AS name, CAST(item_id AS VARCHAR) AS doc_id, item_id % 2 = 0 AS has_ann, sha256(text) AS sha256 FROM benchmark",
    "files_in_split_folders": f"SELECT {SPLIT.replace('doc_id', 'item_id')} AS split, count(*) AS files, CAST(sum(length(text)) AS BIGINT) AS characters FROM benchmark GROUP BY 1",
    "read_settings": "SELECT r_name AS key, CAST(r_regionkey + 100 AS VARCHAR) AS value FROM region UNION ALL SELECT n_name, CAST(CASE WHEN n_regionkey = 0 THEN -1 ELSE n_regionkey END AS VARCHAR) FROM nation UNION ALL SELECT 'layout', 'official'",
    "read_split_arrays": f"SELECT split, count(*) AS records, CAST(sum(length(text)) AS BIGINT) AS characters, min(item_id) AS first_id, count(*) AS in_summary FROM (SELECT *, {SPLIT.replace('doc_id', 'item_id')} AS split FROM (SELECT doc_id AS item_id, text FROM documents)) GROUP BY 1",
    "read_sweep_files": f"WITH {FLAT}, {PER_CELL}, s AS ({FLAT_ROWS}) SELECT kind, cell, correct, round(f1, 9) AS f1 FROM s, (VALUES ('csv'), ('json')) k(kind)",
    "read_run_files": f"WITH q AS ({ORACLES['positive_weights']}) SELECT 'balance:' || tag AS what, round(weight, 9) AS value FROM q UNION ALL SELECT 'metrics:micro_f1', round(micro_f1, 9) FROM ({ORACLES['score_exact']})",
    "error_report": f"WITH {RECORDS}, l AS (SELECT id || ': ' || error AS line FROM errors), n AS (SELECT count(*) AS n FROM l) SELECT line FROM (SELECT line FROM l ORDER BY line LIMIT 200) UNION ALL SELECT '... ' || (n - 200) || ' additional errors' FROM n WHERE n > 200 UNION ALL SELECT 'total ' || n FROM n",
    "stream_record_errors": f"WITH {RECORDS} SELECT id, error FROM errors",
}
