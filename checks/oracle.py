"""The registered queries as SQL over the same tables, written independently of the Spark code."""

from __future__ import annotations

from checks.queries import CONDITIONS, FOUND, RETRIEVED, SAMPLE_CAP, TOP_K
from checks.star import GATE_SPECS, LINEITEM_COLUMNS, SPECS

DOUBLES = {"c_acctbal", "p_retailprice", "o_totalprice", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "value",
           "s_acctbal"}
TEXTS = {"c_name", "c_mktsegment", "p_name", "p_brand", "p_type", "o_orderstatus", "o_orderpriority", "l_returnflag",
         "l_linestatus", "event_type", "props", "text", "lang", "source", "n_name", "s_name"}
ALL_COLUMNS = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
}
SPACE = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160))"


def features(spec, name):
    if spec.columns:
        return list(spec.columns)
    return [c for c in ALL_COLUMNS[name] if c != spec.target and c not in spec.id_columns]


def cleaned(col: str) -> str:
    if col in DOUBLES:
        return f"coalesce(round({col}, 2)::varchar, 'unknown')"
    if col in TEXTS:
        return f"coalesce(regexp_replace(trim({col}, {SPACE}), '\\.$', ''), 'unknown')"
    return f"coalesce({col}::varchar, 'unknown')"


def sentence(columns) -> str:
    return " || ' ' || ".join(f"'The {c} is ' || {cleaned(c)} || '.'" for c in columns)


def row_id(spec) -> str:
    if len(spec.id_columns) == 1:
        return f"{spec.id_columns[0]}::varchar"
    return "md5(to_json({" + ", ".join(f"c{i}: {c}::varchar" for i, c in enumerate(LINEITEM_COLUMNS)) + "})::varchar)"


def raw_samples(specs=SPECS, target=None, source=None) -> str:
    target, source = target or {}, source or {}
    parts = []
    for pos, (name, s) in enumerate(specs.items()):
        label = target.get(name, f"{s.target}::varchar")
        parts.append(
            f"SELECT {pos} AS dataset_pos, '{s.key}' AS dataset_key, '{s.name}' AS dataset, '{s.benchmark}' AS benchmark, "
            f"'{s.sub_benchmark}' AS sub_benchmark, '{s.task_type}' AS task_type, {row_id(s)} AS row_id, "
            f"{sentence(features(s, name))} AS text, coalesce({label}, 'nan') AS label FROM {source.get(name, name)}")
    return " UNION ALL ".join(parts)


DRAW = "substr(md5(concat_ws('|', '42', dataset_key, row_id)), 1, 16)"
RAW = f"raw AS ({raw_samples()})"
# Gate on rows before the length filter.
BUILT = (f"{RAW}, drawn AS (SELECT *, {DRAW} AS draw, count(*) OVER (PARTITION BY dataset_key) AS n_all FROM raw), "
         "built AS (SELECT * FROM drawn WHERE n_all >= 100 AND length(text) <= 14336)")
CORPUS = f"{BUILT}, corpus AS (SELECT *, row_number() OVER (ORDER BY dataset_pos, draw, row_id) - 1 AS idx FROM built)"
SPLIT = (
    f"{BUILT}, per_class AS (SELECT dataset_key, label, count(*) AS n FROM built GROUP BY ALL), "
    "kept AS (SELECT dataset_key FROM per_class GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50 "
    "AND count(*)::double / sum(n)::double <= 0.1::double AND min(n) >= 2), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY dataset_key, label ORDER BY draw, row_id) AS rn, "
    "count(*) OVER (PARTITION BY dataset_key, label) AS n FROM built JOIN kept USING (dataset_key)), "
    "split AS (SELECT *, CASE WHEN rn <= least(greatest(1, floor(n * 0.8::double)), n - 1) THEN 'train' ELSE 'test' END AS split FROM ranked)")


def cell_parts() -> tuple[str, str]:
    nums, cats = [], []
    for name, s in SPECS.items():
        for c in features(s, name):
            at = f"FROM corpus c JOIN (SELECT {row_id(s)} AS row_id, * FROM {name}) t USING (row_id) WHERE c.dataset_key = '{s.key}' AND t.{c} IS NOT NULL"
            if s.kinds.get(c) in ("float", "int"):
                nums.append(f"SELECT idx, dataset_pos, '{c}' AS field, t.{c}::double AS num {at}")
            else:
                cats.append(f"SELECT idx, dataset_pos, '{c}' AS field, t.{c}::varchar AS str {at}")
    return " UNION ALL ".join(nums), " UNION ALL ".join(cats)


NUMS, CATS = cell_parts()
CELLS = f"{CORPUS}, nums AS ({NUMS}), cats AS ({CATS})"


def predicate(field: str, kind: str, op: str, num, value) -> str:
    if kind == "categorical":
        return f"{field}::varchar = '{value}'"
    t = f"({num!r})::float"
    if op == "==":
        return f"abs({field}::float - {t}) < 1e-6::float"
    return f"{field}::float {op} {t}"


def condition_groups() -> dict[str, list[tuple]]:
    groups: dict[str, list[tuple]] = {}
    for q, pos, field, kind, op, num, value in CONDITIONS:
        if kind == "categorical" or op in ("==", ">", "<"):
            groups.setdefault(q, []).append((pos, field, kind, op, num, value))
    return groups


def matched(queries: list[str] | None = None, single: bool = False) -> str:
    """Direct filters on the source tables."""
    parts = []
    for q, conds in condition_groups().items():
        if queries is not None and q not in queries:
            continue
        for name, s in SPECS.items():
            usable = [c for c in conds if c[1] in features(s, name)]
            base = f"FROM corpus c JOIN (SELECT {row_id(s)} AS row_id, * FROM {name}) t USING (row_id) WHERE c.dataset_key = '{s.key}'"
            if single:
                parts += [f"SELECT '{q}' AS query_id, {c[0]} AS pos, idx {base} AND {predicate('t.' + c[1], *c[2:])}" for c in usable]
            elif len(usable) == len(conds):
                tests = " AND ".join(predicate("t." + c[1], *c[2:]) for c in conds)
                parts.append(f"SELECT '{q}' AS query_id, idx {base} AND {tests}")
    return " UNION ALL ".join(parts)


BIN_CELLS = 4096
BINS = (f"{CELLS}, placed AS (SELECT field, num::float AS num, (row_number() OVER (PARTITION BY field ORDER BY num::float, idx) - 1) // {BIN_CELLS} AS bin FROM nums), "
        "bins AS (SELECT field, bin, count(*) AS n, min(num) AS lo, max(num) AS hi FROM placed GROUP BY 1, 2)")


# --- query workload -----------------------------------------------------------------------------

QUOTAS = [("numeric", 1, 10), ("numeric", 2, 10), ("numeric", 3, 10), ("categorical", 1, 10), ("categorical", 2, 10),
          ("categorical", 3, 10), ("mixed", 2, 15), ("mixed", 3, 15)]
# Tables in pool order: those with one kind of column first.
POOLS = {"numeric": ["customer", "part", "orders", "lineitem", "events"],
         "categorical": ["documents", "customer", "part", "orders", "lineitem", "events"],
         "mixed": ["customer", "part", "orders", "lineitem", "events"]}


def draw(*purpose: str) -> str:
    return "md5(concat_ws('|', '42', query_type, num_conditions, attempt, " + ", ".join(purpose) + "))"


def integer(digest: str, digits: int = 8) -> str:
    return f"('0x' || substr({digest}, 1, {digits}))::bigint"


def attempts(times: int) -> str:
    """CTEs from attempts to conditions, for attempts 1..times*target."""
    positions = {name: i for i, name in enumerate(SPECS)}
    order = ", ".join(f"('{t}', {positions[n]}, {i})" for t, names in POOLS.items() for i, n in enumerate(names))
    quotas = ", ".join(f"('{t}', {n}, {q})" for t, n, q in QUOTAS)
    margin = f"(abs(num) * (0.05::double + 0.45::double * ({integer(draw(chr(39) + 'margin' + chr(39), 'field'))} / 4294967296::double)) + 0.01::double)"
    return (
        f"{CELLS}, sizes AS (SELECT dataset_pos, count(*) AS n, min(idx) AS first_idx FROM corpus GROUP BY 1), "
        f"pool_order(query_type, dataset_pos, place) AS (VALUES {order}), "
        "pool AS (SELECT query_type, first_idx, n, sum(n) OVER w - n AS pool_start, sum(n) OVER w AS pool_end, "
        "sum(n) OVER (PARTITION BY query_type) AS pool_rows FROM pool_order JOIN sizes USING (dataset_pos) "
        "WINDOW w AS (PARTITION BY query_type ORDER BY place)), "
        "pool_size AS (SELECT DISTINCT query_type, pool_rows FROM pool), "
        f"quota(query_type, num_conditions, target) AS (VALUES {quotas}), "
        f"att AS (SELECT query_type, num_conditions, target, unnest(range(1, {times} * target + 1)) AS attempt FROM quota), "
        f"tried AS MATERIALIZED (SELECT query_type, num_conditions, target, attempt, ({integer(draw(chr(39) + 'seed' + chr(39)), 15)} % pool_rows)::bigint AS pool_no, "
        f"CASE query_type WHEN 'numeric' THEN num_conditions WHEN 'categorical' THEN 0 ELSE 1 + {integer(draw(chr(39) + 'mix' + chr(39)))} % greatest(num_conditions - 1, 1) END AS n_numeric "
        "FROM att JOIN pool_size USING (query_type)), "
        "seeded AS MATERIALIZED (SELECT t.*, num_conditions - n_numeric AS n_categorical, (first_idx + pool_no - pool_start)::bigint AS idx "
        "FROM tried t JOIN pool p ON t.query_type = p.query_type AND pool_no >= pool_start AND pool_no < pool_end), "
        "pick AS (SELECT query_type, num_conditions, attempt, n_numeric AS wanted, 'numeric' AS type, field, num, NULL AS str FROM seeded JOIN nums USING (idx) "
        "UNION ALL SELECT query_type, num_conditions, attempt, n_categorical, 'categorical', field, NULL, str FROM seeded JOIN cats USING (idx)), "
        f"placed AS (SELECT *, row_number() OVER (PARTITION BY query_type, num_conditions, attempt, type ORDER BY {draw(chr(39) + 'col' + chr(39), 'type', 'field')}, field) AS place FROM pick), "
        "chosen AS MATERIALIZED (SELECT * FROM placed WHERE place <= wanted), "
        f"shaped AS (SELECT *, {integer(draw(chr(39) + 'op' + chr(39), 'field'))} % 3 AS choice, {margin} AS margin, "
        "row_number() OVER (PARTITION BY query_type, num_conditions, attempt ORDER BY type DESC, place) AS pos, "
        "count(*) OVER (PARTITION BY query_type, num_conditions, attempt) AS found FROM chosen), "
        "conds AS MATERIALIZED (SELECT query_type, num_conditions, attempt, pos, field, type, "
        "CASE WHEN type = 'categorical' OR choice = 0 THEN '==' WHEN choice = 1 THEN '>' ELSE '<' END AS operator, "
        "CASE WHEN type = 'numeric' THEN round(CASE choice WHEN 0 THEN num WHEN 1 THEN num - margin ELSE num + margin END, 2) END AS num, str "
        "FROM shaped WHERE found = num_conditions)")


def slot(i: int, table: str, columns: list[tuple[str, bool]]) -> str:
    """Test of condition i of a candidate on a row of one table."""
    number = "CASE f{0} " + " ".join(f"WHEN '{c}' THEN t.{c}::float" for c, n in columns if n) + " END"
    word = "CASE f{0} " + " ".join(f"WHEN '{c}' THEN t.{c}::varchar" for c, n in columns if not n) + " END"
    number, word = number.format(i), word.format(i)
    tests = []
    if any(n for _, n in columns):
        tests.append(f"(y{i} = 'numeric' AND CASE o{i} WHEN '==' THEN abs({number} - n{i}) < 1e-6::float WHEN '>' THEN {number} > n{i} ELSE {number} < n{i} END)")
    if any(not n for _, n in columns):
        tests.append(f"(y{i} = 'categorical' AND {word} = s{i})")
    return f"(f{i} IS NULL OR " + " OR ".join(tests) + ")"


def workload() -> str:
    """CTEs up to `accepted` (numbered queries) and `qrels`."""
    slots = ", ".join(
        f"max(CASE WHEN pos = {i} THEN field END) AS f{i}, max(CASE WHEN pos = {i} THEN type END) AS y{i}, "
        f"max(CASE WHEN pos = {i} THEN operator END) AS o{i}, max(CASE WHEN pos = {i} THEN num END)::float AS n{i}, "
        f"max(CASE WHEN pos = {i} THEN str END) AS s{i}" for i in (1, 2, 3))
    pairs = []
    for name, s in SPECS.items():
        columns = [(c, s.kinds.get(c) in ("float", "int")) for c in features(s, name)]
        listed = ", ".join(f"'{c}'" for c, _ in columns)
        rows = f"(SELECT idx, t.* FROM corpus c JOIN (SELECT {row_id(s)} AS row_id, * FROM {name}) t USING (row_id) WHERE c.dataset_key = '{s.key}')"
        tests = " AND ".join(slot(i, name, columns) for i in (1, 2, 3))
        pairs.append(f"SELECT query_type, num_conditions, attempt, idx FROM (SELECT * FROM wide WHERE f1 IN ({listed})) w JOIN {rows} t ON {tests}")
    words = "CASE operator WHEN '==' THEN ' is ' WHEN '>' THEN ' greater than ' ELSE ' less than ' END"
    value = "CASE WHEN type = 'categorical' THEN str WHEN num = floor(num) THEN num::bigint::varchar ELSE num::varchar END"
    return (
        f"{attempts(50)}, wide AS MATERIALIZED (SELECT query_type, num_conditions, attempt, {slots} FROM conds GROUP BY 1, 2, 3), "
        f"pairs AS MATERIALIZED ({' UNION ALL '.join(pairs)}), "
        "counts AS (SELECT query_type, num_conditions, attempt, count(*) AS num_matches FROM pairs GROUP BY 1, 2, 3 HAVING count(*) >= 5), "
        "firsts AS (SELECT *, row_number() OVER (PARTITION BY query_type, num_conditions ORDER BY attempt) AS place FROM counts JOIN quota USING (query_type, num_conditions)), "
        f"texts AS (SELECT query_type, num_conditions, attempt, 'find records where ' || string_agg(field || {words} || {value}, ' and ' ORDER BY pos) AS query_text FROM conds GROUP BY 1, 2, 3), "
        "accepted AS (SELECT 'retrieval_' || query_type || '_' || lpad(row_number() OVER (PARTITION BY query_type ORDER BY num_conditions, attempt)::varchar, 6, '0') AS query_id, "
        "query_type, num_conditions, attempt, num_matches, query_text FROM firsts JOIN texts USING (query_type, num_conditions, attempt) WHERE place <= target), "
        "qrels AS (SELECT query_id, idx FROM accepted JOIN pairs USING (query_type, num_conditions, attempt))")


# --- vectors and metrics ------------------------------------------------------------------------

HITS = (
    "scored AS (SELECT q.vec_id AS query_id, c.vec_id AS idx, q.label AS q_label, c.label AS c_label, "
    "round(list_dot_product(q.embedding::double[], c.embedding::double[]), 10) AS score "
    "FROM embeddings q JOIN embeddings c ON {pairs}), "
    "hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, idx) AS rank FROM scored) WHERE rank <= 100)")
OTHERS = HITS.format(pairs="q.vec_id <> c.vec_id")
ALL_PAIRS = HITS.format(pairs="true")
VECTOR_QUERIES = (
    "queries AS (SELECT vec_id AS query_id, CASE label % 3 WHEN 0 THEN 'numeric' WHEN 1 THEN 'categorical' ELSE 'mixed' END AS query_type, "
    "1 + (vec_id // 10) % 3 AS num_conditions, count(*) OVER (PARTITION BY label) - 1 AS num_matches FROM embeddings)")


def per_query(hits: str = OTHERS) -> str:
    ks = ", ".join(f"({k})" for k in TOP_K)
    return (
        f"{hits}, {VECTOR_QUERIES}, judged AS (SELECT *, CASE WHEN q_label = c_label AND query_id <> idx THEN 1 ELSE 0 END AS rel FROM hits), "
        "running AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) AS found FROM judged), "
        f"ks(k) AS (VALUES {ks}), "
        "ideal AS (SELECT k, n, sum(1 / log2(r + 1)) AS best FROM ks, (SELECT DISTINCT num_matches AS n FROM queries) m, range(1, 101) t(r) WHERE r <= least(k, n) GROUP BY ALL), "
        "sums AS (SELECT query_id, k, sum(rel) AS hits, min(CASE WHEN rel = 1 THEN rank END) AS first, "
        "sum(CASE WHEN rel = 1 THEN found / rank ELSE 0 END) AS gain, sum(CASE WHEN rel = 1 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg "
        "FROM running JOIN ks ON rank <= k GROUP BY 1, 2), "
        "per_query AS (SELECT q.query_id, query_type, num_conditions, k, coalesce(hits, 0) / num_matches AS recall, coalesce(hits, 0) / k AS precision, "
        "coalesce(dcg, 0) / best AS ndcg, coalesce(1 / first, 0) AS mrr, coalesce(gain, 0) / num_matches AS map "
        "FROM queries q CROSS JOIN ks LEFT JOIN sums s USING (query_id, k) JOIN ideal i ON i.k = ks.k AND i.n = num_matches WHERE num_matches > 0)")


def cube(hits: str = OTHERS, extra: str = "") -> str:
    return (
        f"WITH {per_query(hits)}, long AS (UNPIVOT per_query ON recall, precision, ndcg, mrr, map INTO NAME metric VALUE v) "
        "SELECT metric, k::bigint AS k, CASE WHEN grouping(query_type) = 1 AND grouping(num_conditions) = 1 THEN 'overall' "
        "WHEN grouping(num_conditions) = 1 THEN 'by_type' WHEN grouping(query_type) = 1 THEN 'by_num_conditions' ELSE 'by_type_conditions' END AS breakdown, "
        "coalesce(query_type, 'all') AS query_type, coalesce(num_conditions, 0)::bigint AS num_conditions, count(*) AS n_queries, round(avg(v), 9) AS mean, "
        "CASE WHEN grouping(query_type) = 1 AND grouping(num_conditions) = 1 THEN round(stddev_pop(v), 9) ELSE -1 END AS std" + extra +
        " FROM long GROUP BY GROUPING SETS ((metric, k, query_type, num_conditions), (metric, k, query_type), (metric, k, num_conditions), (metric, k))")


GUESSES = (
    f"{OTHERS}, rows AS (SELECT vec_id, 'vectors/' || (vec_id % 5) AS dataset_key, 'b' || (vec_id % 5 % 2) AS benchmark, label FROM embeddings), "
    "placed AS (SELECT *, row_number() OVER (PARTITION BY dataset_key, label ORDER BY md5(concat_ws('|', '42', dataset_key, vec_id::varchar)), vec_id::varchar) AS rn, "
    "count(*) OVER (PARTITION BY dataset_key, label) AS n FROM rows), "
    "guesses AS (SELECT dataset_key, benchmark, CASE WHEN rn <= least(greatest(1, floor(n * 0.8::double)), n - 1) THEN 'train' ELSE 'test' END AS split, "
    "label AS class, c_label AS prediction FROM placed JOIN hits ON query_id = vec_id AND rank = 1), "
    "acc AS (SELECT dataset_key, split, count(*) AS n_rows, avg((class = prediction)::int) AS accuracy FROM guesses GROUP BY 1, 2), "
    "seen AS (SELECT dataset_key, split, class AS c FROM guesses UNION SELECT dataset_key, split, prediction FROM guesses), "
    "per_class AS (SELECT s.dataset_key, s.split, s.c, 2.0::double * count(*) FILTER (WHERE class = c AND prediction = c) / "
    "(count(*) FILTER (WHERE class = c) + count(*) FILTER (WHERE prediction = c)) AS f1 "
    "FROM seen s JOIN guesses g ON s.dataset_key = g.dataset_key AND s.split = g.split GROUP BY 1, 2, 3), "
    "f1 AS (SELECT dataset_key, split, avg(f1) AS macro_f1 FROM per_class GROUP BY 1, 2), "
    "scores AS (SELECT a.dataset_key, max(benchmark) AS benchmark, max(num_classes) AS num_classes, "
    "max(CASE WHEN a.split = 'train' THEN n_rows END) AS train_samples, max(CASE WHEN a.split = 'test' THEN n_rows END) AS test_samples, "
    "max(CASE WHEN a.split = 'train' THEN accuracy END) AS train_accuracy, max(CASE WHEN a.split = 'test' THEN accuracy END) AS test_accuracy, "
    "max(CASE WHEN a.split = 'train' THEN macro_f1 END) AS train_f1, max(CASE WHEN a.split = 'test' THEN macro_f1 END) AS test_f1 "
    "FROM acc a JOIN f1 USING (dataset_key, split) JOIN (SELECT dataset_key, max(benchmark) AS benchmark, count(DISTINCT CASE WHEN split = 'train' THEN class END) AS num_classes FROM guesses GROUP BY 1) USING (dataset_key) GROUP BY 1)")


# --- catalog ------------------------------------------------------------------------------------

TREE = [  # folder, key, benchmark, sub benchmark, name, task, data, target
    ("openml_cc18/customer_1", "openml_cc18/customer", "openml_cc18", "", "customer", "clf", "mixed", "c_mktsegment"),
    ("grinsztajn/num_clf/part_2", "grinsztajn/num_clf/part", "grinsztajn", "num_clf", "part", "clf", "num", "p_type"),
    ("openml_ctr23/orders_3", "openml_ctr23/orders", "openml_ctr23", "", "orders", "reg", "mixed", "o_totalprice"),
    ("unipredict/someone/events_4", "unipredict/someone/events", "unipredict", "", "events", "clf", "mixed", "event_type"),
    ("unipredict/other/documents_5", "unipredict/other/documents", "unipredict", "", "documents", "clf", "mixed", "lang"),
]
TREE_KINDS = {"c_nationkey": "int", "c_acctbal": "float", "p_size": "int", "p_retailprice": "float", "value": "float",
              "n_chars": "int"}


def tree_rows(columns, where=lambda t: True) -> str:
    return " UNION ALL ".join(f"SELECT {columns(t)} FROM {t[4]}" for t in TREE if where(t))


def tree_columns(target: bool) -> list[tuple]:
    """(folder, table, position, column, declared kind, is target); the supplier folder is off the layout."""
    rows = []
    for folder, _, _, _, name, _, _, tgt in [*TREE, ("elsewhere/supplier_6", None, None, None, "supplier", None, None, "s_nationkey")]:
        columns = [c for c in ALL_COLUMNS[name] if c != tgt] + [tgt]
        for pos, c in enumerate(columns):
            if target or c != tgt:
                kind = "float" if c == "o_totalprice" else TREE_KINDS.get(c, "category") if name != "supplier" else "category"
                rows.append((folder, name, pos, c, kind, c == tgt))
    return rows


def sql() -> dict[str, str]:
    w = f"WITH {workload()} "
    num2 = "WITH " + attempts(1)
    groups = {"pred_num_eq": ["q01"], "pred_num_gt": ["q02"], "pred_num_lt": ["q03"], "pred_cat_eq": ["q04", "q09"],
              "pred_conjunction": ["q05", "q06", "q07", "q08", "q10", "q11"]}
    dims = "dataset_key, label"
    gate_raw = raw_samples(GATE_SPECS)
    changed = raw_samples(GATE_SPECS, {"customer": "CASE WHEN c_custkey = 0 THEN 'RARE' ELSE c_mktsegment END", "documents": "'one'"})
    short = "CASE WHEN {0} = floor({0}) THEN {0}::bigint::varchar ELSE {0}::varchar END"
    return {
        "catalog_discover": tree_rows(lambda t: f"'{t[1]}' AS dataset_key, '{t[2]}' AS benchmark, '{t[3]}' AS sub_benchmark, '{t[4]}' AS name, '{t[5]}' AS task_type, '{t[6]}' AS data_type, '{t[7]}' AS target, count(*) AS n_rows"),
        "catalog_filter": tree_rows(lambda t: f"'{t[1]}' AS dataset_key, '{t[2]}' AS benchmark, count(*) AS n_rows", lambda t: t[2] in ("unipredict", "openml_cc18")),
        "catalog_counts": f"SELECT benchmark, count(*) AS n_datasets, sum(n)::bigint AS n_rows FROM ({tree_rows(lambda t: f'{chr(39)}{t[2]}{chr(39)} AS benchmark, count(*) AS n')}) GROUP BY 1",
        "features_scan": " UNION ALL ".join(f"SELECT '{f}' AS folder, {p}::bigint AS pos, '{c}' AS name, '{k}' AS kind, {'true' if t else 'false'} AS is_target, count({c}) AS n_filled FROM {n}" for f, n, p, c, k, t in tree_columns(True)),
        "target_resolve": tree_rows(lambda t: f"'{t[0]}' AS folder, '{t[7]}' AS target, count(DISTINCT {t[7]}) AS n_classes"),
        "column_kinds": " UNION ALL ".join(f"SELECT '{f}' AS folder, '{c}' AS column, '{'numeric' if k in ('int', 'float') else 'categorical'}' AS kind, count({c}) AS n_filled FROM {n}" for f, n, p, c, k, t in tree_columns(False)),
        "scan_table": "SELECT c_custkey, c_name, c_nationkey::bigint AS c_nationkey, c_acctbal, c_mktsegment FROM customer",
        "scan_documents": "SELECT doc_id, text, lang, source, n_chars FROM documents",
        "jsonl_roundtrip": f"WITH {BUILT} SELECT dataset_key, text, label FROM built",
        "load_splits": f"WITH {SPLIT} SELECT benchmark, sub_benchmark, dataset, split, label, text FROM split WHERE dataset IN ('orders', 'customer', 'documents')",
        "load_retrieval": w + "SELECT query_id, dataset, count(*) AS n_rows FROM qrels JOIN corpus USING (idx) GROUP BY 1, 2",
        "csv_projection": f"SELECT o_orderstatus, {short.format('round(o_totalprice, 2)')} AS o_totalprice, o_orderdate::varchar AS o_orderdate, o_orderpriority FROM orders",
        "split_metadata": f"WITH {SPLIT}, per AS (SELECT dataset_key, label, count(*) FILTER (WHERE split = 'train') AS train_rows, count(*) FILTER (WHERE split = 'test') AS test_rows FROM split GROUP BY 1, 2) "
                          "SELECT dataset_key, count(*) OVER p AS num_labels, (sum(train_rows) OVER p)::bigint AS train_samples, (sum(test_rows) OVER p)::bigint AS test_samples, label, train_rows, test_rows FROM per WINDOW p AS (PARTITION BY dataset_key)",
        "clf_stats": f"WITH {SPLIT} SELECT coalesce(benchmark, 'all') AS benchmark, count(DISTINCT dataset_key) AS datasets, count(*) AS samples FROM split GROUP BY GROUPING SETS ((benchmark), ())",
        "retrieval_stats": w + "SELECT coalesce(query_type, 'all') AS query_type, count(*) AS num_queries, (SELECT count(*) FROM corpus) AS corpus_size FROM accepted GROUP BY GROUPING SETS ((query_type), ())",
        "results_sink": cube(extra=", 'vectors' AS model, '20240101_000000' AS run_ts"),
        "serialize_row": f"WITH {RAW} SELECT dataset_key, row_id, text FROM raw",
        "clean_value": "SELECT doc_id, regexp_replace(trim(chr(9) || ' ' || text || '.. ', {0}), '\\.$', '') AS padded, regexp_replace(trim(text, {0}), '\\.$', '') AS plain, "
                       "CASE WHEN lang = 'en' THEN regexp_replace(source, '\\.$', '') ELSE 'unknown' END AS maybe, "
                       "CASE n_chars % 8 WHEN 1 THEN (n_chars // 8)::varchar || '.12' WHEN 3 THEN (n_chars // 8)::varchar || '.38' WHEN 5 THEN (n_chars // 8)::varchar || '.62' WHEN 7 THEN (n_chars // 8)::varchar || '.88' ELSE (n_chars / 8::double)::varchar END AS eighth, "
                       "CASE WHEN n_chars > 500 THEN (n_chars * 100000)::varchar || '.0' ELSE 'unknown' END AS large, "
                       "(n_chars > 500)::int::varchar AS flag, n_chars::varchar AS whole FROM documents".format(SPACE),
        "is_numeric": "SELECT event_id, regexp_full_match(regexp_extract(props, ':\\s*([^}]*)', 1), '-?\\d+(\\.\\d+)?')::int AS is_a, regexp_full_match(value::varchar, '-?\\d+(\\.\\d+)?')::int AS is_b, 1 AS is_c, 0 AS is_d FROM events",
        "dataset_key": f"WITH {RAW} SELECT dataset_key AS made_key, count(*) AS n_rows FROM raw GROUP BY 1",
        "seed_hash": f"WITH {RAW}, d AS (SELECT dataset_key, row_id, {DRAW} AS draw FROM raw) SELECT *, {integer('draw')} AS draw_int FROM d",
        "length_filter": f"WITH {RAW} SELECT dataset_key, count(*) AS n_rows, max(length(text)) AS longest FROM raw WHERE length(text) <= 14336 GROUP BY 1",
        "gate_min_samples": f"WITH g AS ({gate_raw}) SELECT dataset_key, count(*) AS n_rows FROM g GROUP BY 1 HAVING count(*) >= 100",
        "gate_classes": f"WITH g AS ({changed}), c AS (SELECT {dims}, count(*) AS n FROM g GROUP BY 1, 2), s AS (SELECT dataset_key, count(*) AS num_labels, sum(n)::bigint AS num_samples, min(n) AS rarest, count(*)::double / sum(n)::double AS r FROM c GROUP BY 1 HAVING sum(n) >= 100) "
                        "SELECT dataset_key, num_labels, num_samples, rarest, round(r, 6) AS label_ratio, CASE WHEN num_labels < 2 THEN 'single_class' WHEN num_labels > 50 THEN 'too_many_classes' WHEN r > 0.1::double THEN 'label_ratio' WHEN rarest < 2 THEN 'rare_class' ELSE 'kept' END AS verdict FROM s",
        "label_stats": f"WITH {BUILT}, c AS (SELECT {dims}, count(*) AS n FROM built GROUP BY 1, 2) SELECT dataset_key, count(*) AS num_labels, sum(n)::bigint AS num_samples, min(n) AS rarest, round(count(*)::double / sum(n)::double, 8) AS label_ratio FROM c GROUP BY 1",
        "class_counts": f"WITH {BUILT} SELECT {dims}, count(*) AS n_rows FROM built GROUP BY 1, 2",
        "sample_per_dataset": f"WITH {RAW} SELECT dataset_key, row_id, label FROM (SELECT *, row_number() OVER (PARTITION BY dataset_key ORDER BY {DRAW}, row_id) AS rn FROM raw) WHERE rn <= {SAMPLE_CAP}",
        "build_samples": f"WITH {BUILT} SELECT dataset_key, benchmark, task_type, row_id, label, text FROM built",
        "stratified_split": f"WITH {SPLIT} SELECT dataset_key, row_id, label, split FROM split",
        "classification_build": f"WITH {SPLIT} SELECT dataset_key, label, split, count(*) AS n_rows, sum(length(text))::bigint AS n_chars, min(row_id) AS first_id FROM split GROUP BY 1, 2, 3",
        "empty_inputs": f"WITH {RAW} SELECT 'raw' AS stage, count(*) AS n_rows FROM raw UNION ALL SELECT unnest(['samples', 'splits', 'corpus', 'queries', 'conditions', 'qrels', 'totals']), 0",
        "load_split_files": f"WITH {SPLIT} SELECT dataset_key, benchmark, sub_benchmark, dataset, split, label, text FROM split WHERE dataset <> 'documents'",
        "clf_fit_optimum": "SELECT DISTINCT 'vectors/' || (vec_id % 5) AS dataset_key, true AS at_minimum FROM embeddings",
        "final_shuffle": f"WITH {SPLIT} SELECT dataset_key, split, row_number() OVER (PARTITION BY dataset_key, split ORDER BY md5(concat_ws('|', '42', 'final', dataset_key, row_id))) AS position, text FROM split",
        "corpus": f"WITH {CORPUS} SELECT idx, text, label, dataset, benchmark FROM corpus",
        "corpus_idx": f"WITH {CORPUS} SELECT idx, dataset_key, row_id FROM corpus",
        "corpus_counts": f"WITH {CORPUS} SELECT coalesce(dataset_key, 'all') AS dataset_key, count(*) AS n_rows FROM corpus GROUP BY GROUPING SETS ((dataset_key), ())",
        "cells": f"WITH {CELLS} SELECT field AS column, 'numeric' AS kind, count(*) AS n_cells, sum(idx)::bigint AS sum_idx, round(sum(num::float::double), 2) AS sum_num, NULL::bigint AS sum_chars FROM nums GROUP BY 1 "
                 "UNION ALL SELECT field, 'categorical', count(*), sum(idx)::bigint, NULL, sum(length(str))::bigint FROM cats GROUP BY 1",
        "cat_index": f"WITH {CELLS} SELECT field AS column, str, count(*) AS n_rows FROM cats GROUP BY 1, 2",
        "num_index": f"WITH {CELLS} SELECT field AS column, count(*) AS n_rows, round(min(num::float)::double, 4) AS min_value, round(max(num::float)::double, 4) AS max_value FROM nums GROUP BY 1",
        "index_stats": f"WITH {CELLS} SELECT 'numeric' AS kind, count(DISTINCT field) AS n_columns FROM nums UNION ALL SELECT 'categorical', count(DISTINCT field) FROM cats",
        "seed_pools": f"WITH {CORPUS} SELECT unnest(CASE WHEN dataset = 'documents' THEN ['categorical'] ELSE ['numeric', 'categorical', 'mixed'] END) AS query_type, count(*) AS n_rows FROM corpus GROUP BY 1",
        **{name: f"WITH {CORPUS} {matched(qs)}" for name, qs in groups.items()},
        "cond_matches": f"WITH {CORPUS} SELECT query_id, pos, count(*) AS n_rows, sum(idx)::bigint AS sum_idx FROM ({matched(single=True)}) GROUP BY 1, 2",
        "match_division": f"WITH {CORPUS} {matched()}",
        "match_anchor": f"WITH {CORPUS} {matched()}",
        "match_bitmaps": f"WITH {CORPUS} {matched()}",
        "conjunction_counts": w + "SELECT query_id, num_matches FROM accepted",
        "num_blocks": f"WITH {BINS} SELECT field AS column, bin, n, round(lo::double, 4) AS lo, round(hi::double, 4) AS hi FROM bins",
        "range_counts": f"WITH {BINS}, cuts AS (SELECT field, bin, unnest([{{'cut': 'hi', 'at': hi}}, {{'cut': 'mean', 'at': ((lo::double + hi::double) / 2)::float}}]) AS c FROM bins), "
                        "both_sides AS (SELECT field, bin, c.cut AS cut, count(*) FILTER (WHERE num::float > c.at) AS above, count(*) FILTER (WHERE num::float < c.at) AS below FROM cuts JOIN nums USING (field) GROUP BY 1, 2, 3) "
                        "SELECT field || '|' || bin || '|' || cut AS query_id, unnest([1, 2])::bigint AS pos, unnest([above, below]) AS n_rows FROM both_sides",
        "hits_rel_by_condition": w + f", numbers AS (SELECT query_id, unnest(range(1, {RETRIEVED + 1})) AS rank FROM accepted), "
                        f"shown AS (SELECT query_id, rank, {integer('md5(query_id || chr(124) || rank)')} % (SELECT count(*) FROM corpus) AS idx FROM numbers "
                        f"UNION ALL SELECT query_id, place + {RETRIEVED}, idx FROM (SELECT query_id, idx, row_number() OVER (PARTITION BY query_id ORDER BY idx) AS place FROM qrels) WHERE place <= {FOUND}) "
                        "SELECT s.query_id, s.rank, s.idx, (q.idx IS NOT NULL)::bigint AS rel FROM shown s LEFT JOIN qrels q ON q.query_id = s.query_id AND q.idx = s.idx",
        "match_counts": f"WITH {CORPUS} SELECT query_id, count(*) AS num_matches FROM ({matched()}) GROUP BY 1 HAVING count(*) >= 5",
        "query_text": f"WITH {CELLS}, s AS (SELECT field, count(*) AS n, round(min(num::float)::double, 2) AS lo, round(max(num::float)::double, 2) AS hi FROM nums GROUP BY 1) "
                      f"SELECT field AS column, 'find records where ' || field || ' greater than ' || {short.format('lo')} || ' and ' || field || ' less than ' || {short.format('hi')} || ' and rows is ' || n::varchar AS query_text FROM s",
        "gen_mixed": num2 + " SELECT query_type, num_conditions::bigint AS num_conditions, attempt, pool_no, n_numeric::bigint AS n_numeric, (num_conditions - n_numeric)::bigint AS n_categorical FROM tried",
        "gen_columns": num2 + " SELECT query_type, num_conditions::bigint AS num_conditions, attempt, type, place, field FROM chosen",
        "gen_numeric_cond": num2 + " SELECT query_type, num_conditions::bigint AS num_conditions, attempt, pos, field, operator, num FROM conds WHERE type = 'numeric'",
        "gen_categorical_cond": num2 + " SELECT query_type, num_conditions::bigint AS num_conditions, attempt, pos, field, operator, str FROM conds WHERE type = 'categorical'",
        "query_quota": num2 + " SELECT query_type, num_conditions::bigint AS num_conditions, target::bigint AS target, pool_rows::bigint AS pool_rows FROM quota JOIN pool_size USING (query_type)",
        "query_workload": w + "SELECT 'retrieval' AS task, query_id, query_text, query_type, num_conditions::bigint AS num_conditions, num_matches FROM accepted",
        "query_quota_report": w + "SELECT query_type, num_conditions::bigint AS num_conditions, target::bigint AS target, count(query_id) AS generated, target - count(query_id) AS shortfall FROM quota LEFT JOIN accepted USING (query_type, num_conditions) GROUP BY 1, 2, quota.target",
        "ground_truth": w + "SELECT query_id, idx FROM qrels",
        "retrieval_build": w + "SELECT query_id, query_text, dataset_key, count(*) AS n_rows, sum(idx)::bigint AS sum_idx FROM accepted JOIN qrels USING (query_id) JOIN corpus USING (idx) GROUP BY 1, 2, 3",
        "inner_product": "SELECT a.vec_id, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) AS with_next, round(list_dot_product(a.embedding::double[], a.embedding::double[]), 6) AS with_self FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
        "l2_normalize": "WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: (x::double * (label + 0.5::double))::float) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_dot_product(v::double[], v::double[])) AS n FROM s) "
                        "SELECT vec_id, round(sqrt(list_dot_product(list_transform(v, lambda x: (x / n)::float::double), list_transform(v, lambda x: (x / n)::float::double))), 5) AS norm, "
                        "round(list_sum(list_transform(v, lambda x, i: (x / n)::float::double * i)), 4) AS weighted, round((v[1] / n)::float::double, 5) AS first, round((v[64] / n)::float::double, 5) AS last FROM n",
        "embedding_dim": "SELECT max(len(embedding)) AS dim, count(*) AS n_rows FROM embeddings",
        "embed_align": "SELECT doc_id AS id, lang, len(embedding) AS dim, round(list_sum(list_transform(embedding, lambda x, i: x::double * i)), 5) AS weighted FROM documents JOIN embeddings ON doc_id = vec_id",
        "ivf_params": f"WITH {RAW}, n AS (SELECT dataset_key, count(*) AS n_rows, greatest(least(floor(sqrt(count(*)))::bigint, 4096), 1) AS nlist FROM raw GROUP BY 1) SELECT *, least(greatest(8, least(nlist // 5, 128)), nlist) AS nprobe FROM n",
        "topk_flat": f"WITH {OTHERS} SELECT query_id, rank, idx, round(score, 6) AS score FROM hits",
        "topk_ivf_all_clusters": f"WITH {ALL_PAIRS} SELECT query_id, rank, idx, round(score, 6) AS score FROM hits WHERE rank <= 10",
        "topk_ivf_exact": f"WITH {ALL_PAIRS} SELECT query_id, rank, idx, round(score, 6) AS score FROM hits WHERE rank <= 10",
        "hits_rel": f"WITH {OTHERS} SELECT query_id, rank, idx, (q_label = c_label)::bigint AS rel FROM hits",
        "retrieval_metrics": f"WITH {per_query()} SELECT query_id, k::bigint AS k, " + ", ".join(f"round({m}, 6) AS {m}" for m in ("recall", "precision", "ndcg", "mrr", "map")) + " FROM per_query",
        "avg_precision": f"WITH {per_query()} SELECT query_id, query_type, k::bigint AS k, round(map, 6) AS avg_precision FROM per_query",
        "ndcg": f"WITH {per_query()} SELECT query_id, query_type, k::bigint AS k, round(ndcg, 6) AS ndcg FROM per_query",
        "metric_cube": cube(),
        "retrieval_eval": cube(ALL_PAIRS),
        "label_encode": f"WITH {SPLIT} SELECT dataset_key, row_id, label, dense_rank() OVER (PARTITION BY dataset_key ORDER BY label) - 1 AS class FROM split",
        "accuracy": f"WITH {GUESSES} SELECT dataset_key, split, n_rows, round(accuracy, 6) AS accuracy FROM acc",
        "macro_f1": f"WITH {GUESSES} SELECT dataset_key, split, round(macro_f1, 6) AS macro_f1 FROM f1",
        "scan_missing_ints": "SELECT 'The c_custkey is ' || c_custkey || '. The c_nationkey is ' || CASE WHEN c_nationkey = 0 THEN 'unknown' ELSE c_nationkey || '.0' END "
                             "|| '. The c_name is ' || c_name || '.' AS text, nullif(c_nationkey, 0)::double AS c_nationkey FROM customer",
        "topk_ivf_checked": "SELECT vec_id AS query_id, true AS scores_right, true AS in_order, true AS ranks_dense, true AS recall_reached FROM embeddings",
        "ivf_assign_counts": "SELECT count(*) AS n_rows, count(DISTINCT vec_id) AS n_distinct, true AS nearest FROM embeddings",
        "encode_text_counts": f"WITH {BUILT} SELECT dataset_key, count(*) AS n_rows, count(*) AS n_unit FROM built GROUP BY 1",
        "clf_fit_counts": f"WITH {GUESSES} SELECT dataset_key, split, count(*) AS n_rows, count(*) AS n_predicted, true AS known_class FROM guesses GROUP BY 1, 2",
        "classification_eval_counts": f"WITH {SPLIT} SELECT dataset_key, benchmark, count(DISTINCT label) AS num_classes, count(*) FILTER (WHERE split = 'train') AS train_samples, "
                                      "count(*) FILTER (WHERE split = 'test') AS test_samples, true AS beats_majority FROM split GROUP BY 1, 2",
        "clf_scores": f"WITH {GUESSES} SELECT dataset_key, benchmark, num_classes, train_samples, test_samples, round(train_accuracy, 6) AS train_accuracy, round(test_accuracy, 6) AS test_accuracy, round(train_f1, 6) AS train_f1, round(test_f1, 6) AS test_f1 FROM scores",
        "clf_summary": f"WITH {GUESSES} SELECT coalesce(benchmark, 'all') AS benchmark, count(*) AS num_datasets, round(avg(test_accuracy), 6) AS mean_accuracy, round(stddev_pop(test_accuracy), 6) AS std_accuracy, round(avg(test_f1), 6) AS mean_f1, round(stddev_pop(test_f1), 6) AS std_f1 FROM scores GROUP BY GROUPING SETS ((benchmark), ())",
    }
