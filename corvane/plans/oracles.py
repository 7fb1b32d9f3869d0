"""The SQL of the catalogue, for DuckDB, put together from expressions that mirror the column functions."""

from __future__ import annotations

W, L = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}", r"\p{L}\p{N}_"


def rx(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"


def strip(x: str) -> str:
    return rx(x, f"^[{W}]+|[{W}]+$", "")


def collapse(x: str) -> str:
    return strip(rx(x, f"[{W}]+", " "))


def key(x: str) -> str:
    return collapse(rx(f"lower(coalesce({x}, ''))", f"[^{L}{W}]+", " "))


def h(x: str) -> str:
    return f"sha1({key(x)})"


def count(x: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all(coalesce({x}, ''), '{pattern}')) AS INTEGER)"


def tokens(x: str) -> str:
    return count(x, f"[^{W}]+")


def label(x: str) -> str:
    a = rx(f"lower({strip(x)})", rf"[{W}/\\]+", "_")
    return rx(rx(rx(a, "[^0-9a-zA-Z_]+", "_"), "_+", "_"), "^_|_$", "")


def order(seed: int, stage: str, x: str) -> str:
    return f"md5('{seed}|{stage}|' || {x})"


def hex8(x: str) -> str:
    return f"CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT)"


def stats_key(x: str) -> str:
    return f"md5({collapse(f'''replace(replace(replace(coalesce({x}, ''), chr(160), ' '), chr(9) || ' _blank', ' '), chr(8203), '')''')})"


DOCS = "docs AS (SELECT doc_id AS pos, CAST(doc_id AS VARCHAR) AS id, doc_id, text, source AS label, lang AS modality, lang AS corpus_id FROM documents)"


def two_way(source: str, share: str, seed: int, stage: str, names: tuple[str, str], name: str, by: str = "label") -> str:
    """CTEs that split a source by label."""
    return f"""{name}_r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order(seed, stage, 'id')}, id) AS rn_, count(*) OVER (PARTITION BY {by}) AS n_ FROM {source}),
      {name} AS (SELECT * EXCLUDE (rn_, n_), CASE WHEN rn_ <= round_even({share}::DOUBLE * n_, 0) THEN '{names[0]}' ELSE '{names[1]}' END AS split FROM {name}_r)"""


def three_way(source: str, name: str, train: str = "0.8", share: str = "0.5", seed: int = 42) -> str:
    return f"""{two_way(source, train, seed, 'split', ('train', 'rest'), name + '_a')},
      {name}_rest AS (SELECT * EXCLUDE (split) FROM {name}_a WHERE split = 'rest'), {two_way(name + '_rest', share, seed + 1, 'split2', ('dev', 'test'), name + '_b')},
      {name} AS (SELECT * FROM {name}_a WHERE split = 'train' UNION ALL BY NAME SELECT * FROM {name}_b)"""


def leaks(source: str, name: str) -> str:
    rank = "CASE split WHEN 'train' THEN 0 WHEN 'dev' THEN 1 WHEN 'test' THEN 2 ELSE 3 END"
    return f"""{name}_i AS (SELECT *, {h('text')} AS h_, row_number() OVER (PARTITION BY id ORDER BY {rank}, pos) AS i_ FROM {source}),
      {name}_t AS (SELECT pos, split, row_number() OVER (PARTITION BY h_ ORDER BY {rank}, pos) AS t_ FROM {name}_i WHERE i_ = 1),
      {name} AS (SELECT a.* EXCLUDE (h_, i_), coalesce(t_ > 1, true) AS leaked FROM {name}_i a LEFT JOIN {name}_t b ON a.pos = b.pos AND a.split = b.split)"""


PREPARE_VIEW = f"""
  WITH docs AS (SELECT doc_id AS pos, CAST(doc_id AS VARCHAR) AS id, doc_id, text, source AS label, {tokens('text')} AS tokens FROM documents WHERE length(coalesce(text, '')) >= 200),
  kept AS (SELECT * FROM docs QUALIFY row_number() OVER (PARTITION BY {h('text')} ORDER BY pos) = 1),
  {three_way('kept', 's')}, {leaks('s', 'm')}
  SELECT split, label, count(*) AS n, min(doc_id) AS first_id, CAST(sum(tokens) AS BIGINT) AS tokens FROM m WHERE NOT leaked GROUP BY split, label"""

# --- text functions
NORMALIZE_LABEL = f"SELECT page_id, {label('url')} AS label FROM pages"
TOKEN_COUNTS = f"SELECT doc_id, {tokens('text')} AS tokens FROM documents"
TOKEN_COUNTS_SIMPLE = f"SELECT doc_id, {count('text', '[^ ' + chr(92) + 'n]+')} AS tokens FROM documents"
TOKEN_COUNTS_WORD_PUNCT = f"SELECT doc_id, {count('text', f'[{L}]+|[^{L}{W}]')} AS tokens FROM documents"
DEDUP_KEY_HASH = f"SELECT doc_id, {h('text')} AS text_hash FROM documents"
STATS_TEXT_MD5 = f"SELECT doc_id, {stats_key('text')} AS text_md5 FROM documents"
AUDIT_NORM_TEXT = f"""SELECT doc_id, md5({collapse("lower(coalesce(text, ''))")}) AS norm_md5 FROM documents"""
_HOST = "regexp_extract(url, '^https?://([^/]+)', 1)"
_QUOTED = r"'(?i)\Q' || domain || '\E'"
_BARE = r"'(?i)\Q' || substr(domain, 5) || '\E'"
_ONCE = f"CASE WHEN domain <> '' AND (contains(lower(domain), '.') OR contains(lower(domain), ':') OR starts_with(lower(domain), 'crawl') OR length(domain) >= 8) THEN regexp_replace(html, {_QUOTED}, ' ', 'g') ELSE html END"
REDACT_META = f"""
  WITH p AS (SELECT page_id, coalesce(html, '') AS html, {strip(f"coalesce({_HOST}, '')")} AS domain FROM pages),
  q AS (SELECT page_id, domain, {_ONCE} AS html FROM p)
  SELECT page_id, md5({collapse(f"CASE WHEN starts_with(lower(domain), 'www.') AND length(domain) > 4 THEN regexp_replace(html, {_BARE}, ' ', 'g') ELSE html END")}) AS redacted_md5 FROM q"""


def addresses(x: str) -> str:
    return collapse(rx(rx(rx(x, f"https?://[^{W}]+", " "), f"www[.][^{W}]+", " "), f"(^|[^{L}])[{L}][^{W}]*@[^{W}]*[{L}]", chr(92) + "1 "))


STRIP_URLS_EMAILS = f"""SELECT doc_id, md5({addresses("coalesce(text, '')")}) AS stripped_md5 FROM documents"""
# DuckDB has NFC only, which equals NFKC for texts without compatibility characters, as those of the test tables are.
_BASIC = f"""lower({collapse("nfc_normalize(coalesce(text, ''))")})"""
_PLAIN = collapse(f"strip_accents({_BASIC})")
NORMALIZE_BASIC = f"SELECT doc_id, {_BASIC} AS text FROM documents"
NORMALIZE_AGGRESSIVE = f"SELECT doc_id, {_PLAIN} AS text FROM documents"
NORMALIZE_DEBIAS = f"SELECT doc_id, {addresses(_PLAIN)} AS text FROM documents"
# Without spaCy, words and marks are counted.
TOKEN_COUNTS_SPACY = TOKEN_COUNTS_WORD_PUNCT
SHORT_LABELS = "SELECT doc_id, left(replace(replace(regexp_replace(replace(replace('crawl_' || source || '_full_initiative_communiste_20250928_001323', 'crawl_', ''), 'asr_party_', ''), '_[0-9]{8}_[0-9]{6}$', ''), '_full', ''), 'initiative_communiste', 'init_com'), 18) AS short FROM documents"
TRUNCATE_LONG = "SELECT doc_id, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS text_md5 FROM (SELECT doc_id, CASE WHEN length(coalesce(text, '')) > 1000 THEN substr(text, 1, 1000) ELSE text END AS t FROM documents)"

# --- filters
FILTER_MIN_CHARS_MAX_TOKENS = f"SELECT doc_id, tokens FROM (SELECT doc_id, {tokens('text')} AS tokens FROM documents WHERE length(coalesce(text, '')) >= 400) WHERE tokens <= 512"
FILTER_MODALITY = "SELECT doc_id, source AS label FROM documents WHERE lang = 'fr'"
LONG_TEXT_DROP = "SELECT doc_id FROM documents WHERE length(coalesce(text, '')) <= 5000"

# --- labels
_MAP = ", ".join(f"('src{i}', '{'left' if i % 3 else 'right'}')" for i in range(12))


def _mapped(found: str) -> str:
    return f"SELECT doc_id, label FROM (SELECT doc_id, {found} AS label FROM documents LEFT JOIN (VALUES {_MAP}) m(k, v) ON {label('source')} = k) WHERE coalesce(label, '') <> ''"


LABEL_MAP = {"drop": _mapped("v"), "keep": _mapped(f"coalesce(v, {label('source')})"), "other": _mapped("coalesce(v, 'other')")}


def _actor_rows() -> tuple[str, str, str]:
    crawls, domains, rows = [], [], []
    for i in range(8):
        crawls += [f"('src{i}', 'actor{i}')", f"('src_{i + 10}', 'actor{i}')"]
        domains += [f"('{d}', 'actor{i}')" for d in (["en"] if i == 3 else ["fr"] if i == 4 else [])]
        side = ("'left'", "'right'", "NULL")[i % 3]
        rows.append(f"('actor{i}', {side}, 'g{i % 5}', {f'''{chr(39)}l{i}{chr(39)}''' if i % 2 == 0 else 'NULL'}, 'r{i}')")
    return ", ".join(crawls), ", ".join(domains), ", ".join(rows)


_CRAWLS, _DOMAINS, _ACTORS = _actor_rows()
RESOLVED = f"""resolved AS (
    SELECT doc_id, a.* FROM documents d LEFT JOIN (VALUES {_DOMAINS}) x(k, by_domain) ON CASE WHEN doc_id % 5 = 0 THEN lang END = x.k
    LEFT JOIN (VALUES {_CRAWLS}) y(k, by_crawl) ON source = y.k
    LEFT JOIN (VALUES {_ACTORS}) a(actor_id, side_binary, global_five, intra_left, intra_right) ON coalesce(by_domain, by_crawl) = a.actor_id)"""
ACTOR_RESOLUTION = f"WITH {RESOLVED} SELECT doc_id, actor_id, side_binary FROM resolved"


def _view(view: str, column: str | None, side: str | None = None, unknown: str = "dropped") -> str:
    reason = f"WHEN actor_id IS NULL THEN 'unknown_actor_{unknown}'"
    if column is None:
        return f"SELECT doc_id, '{view}' AS \"view\", CAST(NULL AS VARCHAR) AS label, CASE {reason} ELSE 'unknown_view_{view}' END AS reason FROM resolved"
    if side:
        reason += f" WHEN side_binary IS DISTINCT FROM '{side}' THEN 'actor_not_{side}'"
    reason = f"CASE {reason} WHEN {column} IS NULL THEN 'label_missing_for_view' ELSE 'ok' END"
    return f"SELECT doc_id, '{view}' AS \"view\", CASE WHEN {reason} = 'ok' THEN {column} END AS label, {reason} AS reason FROM resolved"


IDEOLOGY_VIEWS = f"WITH {RESOLVED} " + " UNION ALL ".join([_view("binary", "side_binary"), _view("five_way", "global_five"), _view("left_intra", "intra_left", "left"), _view("right_intra", "intra_right", "right"), _view("seven_way", None)])
IDEOLOGY_REASONS = f"WITH {RESOLVED} SELECT reason, count(*) AS n FROM ({_view('left_intra', 'intra_left', 'left', 'kept')}) WHERE reason <> 'ok' GROUP BY reason"
ACTOR_COUNTS = f"WITH {RESOLVED} SELECT coalesce(actor_id, 'unknown') AS actor, count(*) AS n FROM resolved GROUP BY 1"
ACTOR_MIN_DOCS = f"WITH {RESOLVED} SELECT actor_id AS actor, count(*) AS n FROM resolved WHERE actor_id IN ('actor0', 'actor1', 'actor2', 'actor3', 'actor4', 'actor5') GROUP BY 1 HAVING count(*) >= 20"

# --- dedup, limits, samples
_TWICE = f"{DOCS}, twice AS (SELECT * FROM docs UNION ALL SELECT * REPLACE (pos + 1000000000 AS pos) FROM docs WHERE doc_id % 4 = 0)"
DEDUP = {on: f"WITH {_TWICE} SELECT pos, id FROM twice QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY pos) = 1" for on, by in (("id", "id"), ("text", h("text")), ("id_and_text", f"id, {h('text')}"))}
LIMIT_HEAD = "SELECT doc_id, source AS label FROM documents ORDER BY doc_id LIMIT 100"
LIMIT_RANDOM = f"WITH {DOCS} SELECT doc_id, label FROM docs ORDER BY {order(42, 'limit', 'id')}, id LIMIT 100"
SHUFFLED_HEAD = f"WITH {DOCS} SELECT doc_id FROM docs ORDER BY {order(42, 'shuffle', 'id')}, id LIMIT 50"
DEBUG_SUBSAMPLE = f"WITH {DOCS} SELECT doc_id FROM docs ORDER BY {order(42, 'limit', 'id')}, id LIMIT 150"
SAMPLE_WHERE = f"WITH {DOCS} SELECT doc_id, modality FROM docs QUALIFY modality IS DISTINCT FROM 'en' OR row_number() OVER (PARTITION BY modality = 'en' ORDER BY {order(52, 'plot', 'id')}, id) <= 60"

# --- splits and balancing
STRATIFIED_SPLIT = f"WITH {DOCS}, {two_way('docs', '0.8', 42, 'split', ('train', 'test'), 's')} SELECT doc_id, split FROM s"
THREE_WAY_SPLIT = f"WITH {DOCS}, {three_way('docs', 's', '0.7', '(0.2::DOUBLE / (0.2::DOUBLE + 0.1::DOUBLE))')} SELECT doc_id, split FROM s"
_MARKED = f"WITH {DOCS}, {three_way('docs', 's')}, {leaks('s', 'm')}"
LEAK_REMOVAL = f"{_MARKED} SELECT doc_id, split FROM m WHERE NOT leaked"
LEAK_REMOVED_COUNTS = f"{_MARKED} SELECT split, count(*) AS n FROM m WHERE leaked GROUP BY split"


def ranked(source: str, label_of: str = "label") -> str:
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY {label_of} ORDER BY {order(42, 'balance', 'id')}, id) AS r_, count(*) OVER (PARTITION BY {label_of}) AS n_ FROM {source})"""


def duplicates(need: str) -> str:
    pick = f"{hex8(chr(39) + '42|dup|' + chr(39) + ' || l_ || ' + chr(39) + '|' + chr(39) + ' || i_')} % of_ + 1"
    return f"""wanted AS (SELECT label AS l_, max(n_) AS of_, {need} AS need_ FROM ranked GROUP BY label), draws AS (SELECT l_, of_, unnest(range(1, need_ + 1)) AS i_ FROM wanted WHERE need_ > 0),
      more AS (SELECT id || '#dup' || i_ AS id, label FROM draws JOIN ranked ON label = l_ AND r_ = {pick})"""


_START = f"({hex8('label')} + {{offset}}) % n_"
_ROTATED = f"((r_ - 1 - {_START}) % n_ + n_) % n_"
BALANCE_CAP_DOCS = f"WITH {DOCS}, {ranked('docs')} SELECT id, label FROM ranked WHERE {_ROTATED.format(offset=3)} < 30"
_BY_LANG = "langs AS (SELECT CAST(doc_id AS VARCHAR) AS id, lang AS label FROM documents)"
BALANCE_OVERSAMPLE = f"WITH {_BY_LANG}, {ranked('langs')}, {duplicates('greatest(200 - max(n_), 0)')} SELECT id, label FROM ranked WHERE {_ROTATED.format(offset=0)} < 200 UNION ALL SELECT id, label FROM more"
BALANCE_CAP_TOKENS = f"""
  WITH docs AS (SELECT CAST(doc_id AS VARCHAR) AS id, source AS label, {tokens('text')} AS tokens FROM documents), {ranked('docs')},
  rot AS (SELECT *, {_ROTATED.format(offset=1)} AS j_ FROM ranked),
  pre AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY label ORDER BY j_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p_, sum(tokens) OVER (PARTITION BY label) AS t_ FROM rot)
  SELECT id, label FROM pre WHERE p_ < 25000 UNION ALL SELECT id || '#dup' || (j_ + 1) AS id, label FROM pre WHERE t_ < 25000 AND t_ + p_ < 25000"""


def quotas(alpha: str, total: int) -> str:
    return f"""counted AS (SELECT label, count(*) AS n FROM langs GROUP BY label),
      base AS (SELECT *, greatest(1, CAST(round_even({total}::DOUBLE * pow(n, {alpha}) / sum(pow(n, {alpha})) OVER (), 0) AS BIGINT)) AS q_ FROM counted),
      adj AS (SELECT *, CAST({total} - sum(q_) OVER () AS BIGINT) AS d_, count(*) OVER () AS m_, row_number() OVER (ORDER BY label) - 1 AS i_ FROM base),
      quotas AS (SELECT label, n, CAST(q_ + sign(d_) * (abs(d_) // m_ + CASE WHEN i_ < abs(d_) % m_ THEN 1 ELSE 0 END) AS BIGINT) AS quota FROM adj)"""


ALPHA_QUOTAS = f"WITH {_BY_LANG}, {quotas('0.5', 777)} SELECT label, n, quota FROM quotas"
BALANCE_ALPHA_TOTAL = f"""WITH {_BY_LANG}, {quotas('0.3', 600)}, joined AS (SELECT a.id, a.label, quota FROM langs a JOIN quotas q USING (label)), {ranked('joined')}, {duplicates('greatest(max(quota) - max(n_), 0)')}
  SELECT id, label FROM ranked WHERE r_ <= quota UNION ALL SELECT id, label FROM more"""
CLASS_WEIGHTS = f"WITH {_BY_LANG}, c AS (SELECT label, count(*) AS n FROM langs GROUP BY label) SELECT label, round(sum(n) OVER ()::DOUBLE / (count(*) OVER () * n), 6) AS weight FROM c"

# --- aggregates and statistics
LABEL_COUNTS_BY_SPLIT = f"WITH {DOCS}, {three_way('docs', 's')} SELECT split, label, count(*) AS n FROM s GROUP BY split, label"
MODALITY_COUNTS = "SELECT lang AS modality, count(*) AS n FROM documents GROUP BY lang"
LABEL_DISTRIBUTION = "SELECT source AS label, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, label"
LENGTH_PERCENTILES = f"SELECT source AS label, count(*) AS n, round(quantile_cont({tokens('text')}::DOUBLE, 0.5), 6) AS median, round(quantile_cont({tokens('text')}::DOUBLE, 0.9), 6) AS p90 FROM documents GROUP BY source"
DUPLICATES_PER_LABEL = f"SELECT label, count(*) AS duplicates FROM (SELECT source AS label, row_number() OVER (PARTITION BY {stats_key('text')} ORDER BY doc_id) AS r FROM documents) WHERE r > 1 GROUP BY label"
DOCLEN_HISTOGRAM = f"""
  WITH w AS (SELECT lang AS corpus_id, {tokens('text')} AS w FROM documents), s AS (SELECT *, min(w) OVER (PARTITION BY corpus_id) AS lo, max(w) OVER (PARTITION BY corpus_id) AS hi FROM w)
  SELECT corpus_id, CAST(CASE WHEN hi > lo THEN least(floor((w - lo) * 60 / (hi - lo)::DOUBLE), 59) ELSE 0 END AS INTEGER) AS bin, count(*) AS n, (SELECT round(quantile_cont(w::DOUBLE, 0.99), 6) FROM w) AS x_limit FROM s GROUP BY 1, 2"""
ROBUST_LIMITS = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(quantile_cont(embedding[{i}]::DOUBLE, 0.01), 6) AS low, round(quantile_cont(embedding[{i}]::DOUBLE, 0.99), 6) AS high FROM embeddings" for i, c in ((1, "x"), (2, "y")))
TOP_SOURCES = "SELECT source AS label, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, label LIMIT 10"
CHECK_STATS = "SELECT source AS label, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS n_docs, count(*) OVER () AS n_labels FROM documents GROUP BY source"

# --- metrics
_DRAW = f"{hex8(chr(39) + 'p' + chr(39) + ' || doc_id')} % 7"
PRED = f"pred AS (SELECT doc_id, lang AS label, CASE {_DRAW} WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'xx' ELSE lang END AS prediction, source AS corpus_id, CASE WHEN doc_id % 3 = 0 THEN 'web' ELSE 'asr' END AS modality FROM documents)"
_F1 = "CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END"


def scored(source: str, keys: str = "") -> str:
    """CTEs with precision, recall and f1 of each class (of each group of the keys)."""
    k = f"{keys}, " if keys else ""
    return f"""sides AS (SELECT {k}label AS class, 1 AS s, 0 AS q, CASE WHEN label = prediction THEN 1 ELSE 0 END AS t FROM {source} UNION ALL SELECT {k}prediction, 0, 1, 0 FROM {source}),
      tot AS (SELECT {k}class, sum(s) AS s, sum(q) AS q, sum(t) AS t FROM sides GROUP BY {k}class),
      pr AS (SELECT *, CASE WHEN q > 0 THEN t / q::DOUBLE ELSE 0 END AS p, CASE WHEN s > 0 THEN t / s::DOUBLE ELSE 0 END AS r FROM tot), cls AS (SELECT *, {_F1} AS f FROM pr)"""


_ONE = "CAST(sum(s) AS BIGINT) AS n, round(sum(t) / sum(s)::DOUBLE, 6) AS accuracy, round(avg(f), 6) AS macro_f1"
ACCURACY_MACRO_F1 = f"WITH {PRED}, {scored('pred')} SELECT {_ONE} FROM cls"
CLASSIFICATION_REPORT = f"""WITH {PRED}, {scored('pred')}
  SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, s::DOUBLE AS support FROM cls
  UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(s)::DOUBLE FROM cls
  UNION ALL SELECT 'weighted avg', round(sum(p * s) / sum(s), 6), round(sum(r * s) / sum(s), 6), round(sum(f * s) / sum(s), 6), sum(s)::DOUBLE FROM cls
  UNION ALL SELECT 'accuracy', round(sum(t) / sum(s)::DOUBLE, 6), round(sum(t) / sum(s)::DOUBLE, 6), round(sum(t) / sum(s)::DOUBLE, 6), sum(s)::DOUBLE FROM cls"""
_LONG = "long AS (SELECT 'corpus_id' AS field, corpus_id AS value, label, prediction FROM pred UNION ALL SELECT 'modality', modality, label, prediction FROM pred UNION ALL SELECT 'crawl', '__missing__', label, prediction FROM pred)"
GROUPED_METRICS = f"WITH {PRED}, {_LONG}, {scored('long', 'field, value')} SELECT field, value, {_ONE} FROM cls GROUP BY field, value"
BALANCED_SUMMARY = f"""WITH {PRED}, {_LONG}, {scored('long', 'field, value')}, g AS (SELECT value, sum(t) / sum(s)::DOUBLE AS a, avg(f) AS m, CASE value WHEN 'web' THEN 3.0 WHEN 'asr' THEN 1.0 ELSE 0 END AS w FROM cls WHERE field = 'modality' GROUP BY value)
  SELECT round(sum(a * w) / sum(w), 6) AS balanced_accuracy, round(sum(m * w) / sum(w), 6) AS balanced_macro_f1, count(*) AS groups FROM g"""
_CELLS = f"{PRED}, cells AS (SELECT label AS \"true\", prediction AS pred, count(*) AS n FROM pred GROUP BY 1, 2), conf AS (SELECT *, round(n / (sum(n) OVER (PARTITION BY \"true\"))::DOUBLE, 6) AS row_share FROM cells)"
CONFUSION_MATRIX = f'WITH {_CELLS} SELECT "true", pred, n, row_share FROM conf'
TOP_CONFUSIONS = f'WITH {_CELLS} SELECT n AS count, row_share, "true", pred FROM conf WHERE "true" <> pred ORDER BY n DESC, "true", pred LIMIT 40'
CONFUSION_BARS = f"""WITH {_CELLS} SELECT "true" || ' -> ' || pred AS pair, n AS count FROM conf WHERE "true" <> pred ORDER BY n DESC, "true", pred LIMIT 5"""

# --- audits
_JOB = f"WITH {DOCS}, {three_way('docs', 's')}, job AS (SELECT id, {h('text')} AS h, split FROM s UNION ALL SELECT id, {h('text')}, 'job' FROM s WHERE split = 'test')"
SPLIT_AUDIT = f"{_JOB} SELECT split, count(*) AS rows, count(DISTINCT id) AS unique_ids, count(DISTINCT h) AS unique_text_hash FROM job GROUP BY split"
SPLIT_OVERLAP = f"""{_JOB}, i AS (SELECT DISTINCT split, id FROM job), t AS (SELECT DISTINCT split, h FROM job),
  ii AS (SELECT x.split AS a, y.split AS b, count(*) AS id_overlap, array_to_string(list(x.id ORDER BY x.id)[1:10], ',') AS sample_ids FROM i x JOIN i y ON x.id = y.id AND x.split < y.split GROUP BY 1, 2),
  tt AS (SELECT x.split AS a, y.split AS b, count(*) AS text_hash_overlap FROM t x JOIN t y ON x.h = y.h AND x.split < y.split GROUP BY 1, 2)
  SELECT a, b, coalesce(id_overlap, 0) AS id_overlap, coalesce(text_hash_overlap, 0) AS text_hash_overlap, coalesce(sample_ids, '') AS sample_ids FROM ii FULL JOIN tt USING (a, b)"""
SPLIT_ALIAS = f"""{_JOB}, v AS (SELECT 'id' AS k, id AS v, split FROM job WHERE split IN ('job', 'test') UNION ALL SELECT 'text', h, split FROM job WHERE split IN ('job', 'test'))
  SELECT coalesce(min(n) = 2, false) AS is_alias FROM (SELECT count(DISTINCT split) AS n FROM v GROUP BY k, v)"""
_EXTRACTED = f"""x AS (SELECT doc_id AS pos, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'd' || (doc_id % 900) END AS xml_id, CASE WHEN doc_id % 2 = 0 THEN ['MAIL', source] ELSE ['the'] END AS doms,
    CASE WHEN doc_id % 3 > 0 THEN 'tion' || lang ELSE '' END AS cc, CASE WHEN doc_id % 11 = 0 THEN text || ' ' || text ELSE text END AS ta, text AS tn, doc_id % 11 = 0 AS seg FROM documents),
  low AS (SELECT *, {collapse("lower(coalesce(ta, ''))")} AS l FROM x),
  flags AS (SELECT *, xml_id = '' AS mi, len(list_filter(doms, lambda d: length(d) >= 4 AND contains(l, lower(d)))) > 0 AS ld, contains(l, 'example.com') AS lc, length(cc) >= 4 AND contains(l, lower(cc)) AS lk,
    seg AND length(coalesce(tn, '')) > 0 AND length(coalesce(ta, '')) > 1.25 * length(coalesce(tn, '')) AS sr, coalesce(ta, '') = '' AND coalesce(tn, '') = '' AS em FROM low)"""
CORPUS_AUDIT = f"""WITH {_EXTRACTED} SELECT count(*) AS n_docs, count_if(mi) AS missing_xml_id, CAST(0 AS BIGINT) AS missing_text_node, count_if(em) AS empty_text_docs, count_if(seg) AS segments_present_docs, count_if(sr) AS segments_dup_risky_docs,
    count_if(ld) AS leak_domain_in_text_docs, count_if(lc) AS leak_crawl_in_text_docs, count_if(lk) AS leak_classcode_in_text_docs, count_if(NOT mi) - count(DISTINCT CASE WHEN NOT mi THEN xml_id END) AS duplicate_xml_id,
    count_if({key('ta')} <> '') - count(DISTINCT CASE WHEN {key('ta')} <> '' THEN {key('ta')} END) AS duplicate_text_exact_docs FROM flags"""
DOC_ISSUES = f"""WITH {_EXTRACTED}, i AS (SELECT *, concat_ws(';', CASE WHEN mi THEN 'missing_xml_id' END, CASE WHEN ld THEN 'domain_in_text' END, CASE WHEN lc THEN 'crawl_in_text' END, CASE WHEN lk THEN 'classcode_in_text' END, CASE WHEN sr THEN 'segments_dup_risky' END, CASE WHEN {strip("coalesce(ta, '')")} = '' THEN 'empty_text_all' END) AS issues FROM flags)
  SELECT xml_id, issues, CAST(length(coalesce(ta, '')) AS INTEGER) AS len_all, CAST(length(coalesce(tn, '')) AS INTEGER) AS len_no_segments, CAST(len(doms) AS INTEGER) AS n_domains, 1 AS n_crawls, 1 AS n_classcodes FROM i WHERE issues <> ''"""
DOMAIN_PURITY = f"""WITH {_EXTRACTED}, p AS (SELECT unnest(doms) AS d, cc FROM x WHERE cc <> ''), k AS (SELECT d, count(DISTINCT cc) AS k FROM p GROUP BY d)
  SELECT count(*) AS domains_total, count_if(k <= 1) AS domains_pure, round(coalesce(avg(CASE WHEN k <= 1 THEN 1.0 ELSE 0.0 END), 0), 6) AS purity_ratio FROM k"""
METADATA_IN_TEXT = f"WITH {_EXTRACTED} SELECT pos, ld AS domain_in_text, lc AS crawl_in_text, lk AS classcode_in_text FROM flags"
DUPLICATE_PAIRS = f"""WITH d AS (SELECT doc_id, {h('text')} AS h, {key('text')} AS k FROM documents), f AS (SELECT *, min(doc_id) OVER (PARTITION BY h) AS first_id FROM d WHERE k <> '')
  SELECT doc_id AS id, first_id FROM f WHERE doc_id > first_id ORDER BY doc_id LIMIT 20"""

# --- sets
CORPUS_UNION = """SELECT 'docs' AS corpus_id, 'docs__' || doc_id AS id, CAST(length(text) AS INTEGER) AS n_chars FROM documents
  UNION ALL SELECT 'chats', 'chats__' || conv_id || '_' || turn, CAST(length(text) AS INTEGER) FROM conversations UNION ALL SELECT 'bench', 'bench__' || item_id, CAST(length(text) AS INTEGER) FROM benchmark"""
LABEL_UNION = f"WITH {PRED} SELECT label FROM pred UNION SELECT prediction FROM pred ORDER BY 1"
COMMON_TEXTS = f"SELECT {h('text')} AS h FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT {h('text')} FROM documents WHERE doc_id % 2 = 1"
SAME_SET = """WITH a AS (SELECT DISTINCT source FROM documents WHERE doc_id % 2 = 0), b AS (SELECT DISTINCT source FROM documents WHERE doc_id % 2 = 1)
  SELECT count(*) = 0 AS equal FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a))"""

# --- formats and features
ONE_HOT_CATS = "SELECT doc_id, c AS category, CASE WHEN lang = c THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM documents, (VALUES ('de'), ('en'), ('es'), ('fr')) v(c)"


def tfidf(table: str, ident: str, ngrams: int, min_df: int) -> str:
    grams = " UNION ALL ".join(f"SELECT id, unnest(list_transform(range(1, greatest(len(w) - {n - 2}, 1)), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS term FROM words" for n in range(1, ngrams + 1))
    return f"""WITH words AS (SELECT {ident} AS id, regexp_extract_all(lower(coalesce(text, '')), '[{L}]{{2,}}') AS w FROM {table}), g AS ({grams}), tf AS (SELECT id, term, count(*) AS tf FROM g GROUP BY id, term),
      df AS (SELECT term, ln((1 + (SELECT count(*) FROM {table})) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tf GROUP BY term HAVING count(*) >= {min_df}),
      raw AS (SELECT id, tf.term, tf * idf AS raw FROM tf JOIN df USING (term)), weights AS (SELECT id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS weight FROM raw)"""


TFIDF_TERMS = f"{tfidf('benchmark', 'item_id', 2, 2)} SELECT id, term, round(weight, 6) AS weight FROM weights"
TFIDF_TOP = f"{tfidf('documents', 'doc_id', 1, 5)} SELECT term, count(*) AS n, round(sum(weight), 4) AS weight FROM weights GROUP BY term"

TFIDF_VOCABULARY = f"""WITH words AS (SELECT regexp_extract_all(lower(coalesce(text, '')), '[{L}]{{2,}}') AS w, doc_id FROM documents),
  g AS (SELECT doc_id, unnest(w) AS term FROM words UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words)
  SELECT term, count(DISTINCT doc_id) AS df, count(*) AS total FROM g GROUP BY term HAVING count(DISTINCT doc_id) >= 5 ORDER BY total DESC, term LIMIT 100000"""

# --- TEI
_SAFE = "regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', ' ', 'g')"
TEI_EXTRACT = f"SELECT doc_id AS pos, 'd' || doc_id AS xml_id, source AS label_raw, lang AS modality, 'asr_party:p' || (doc_id % 4) AS domain, md5({key(_SAFE + chr(32) + '||' + chr(32) + chr(39) + ' tail' + chr(39))}) AS text_md5 FROM documents"
