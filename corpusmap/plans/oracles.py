"""The registered queries as SQL over the same tables, for DuckDB."""

from __future__ import annotations

from corpusmap.functions.stopwords import ENGLISH
from corpusmap.operators.label import BANNED_WORDS, PROMPT
from corpusmap.plans.fixtures import AXES, ctes
from corpusmap.plans.queries import EPS, MIN_PTS


def _in(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


STOPS = _in(ENGLISH)
BLANKS = " || ".join(
    f"chr({c})" for c in (*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)
)
WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]{{2,}}')"
R = "round({}, 6) + 0.0"

EXTENDED = """
typed AS (SELECT f.dataset_id, f.file_type, t.engine FROM files f LEFT JOIN file_types t ON f.file_type = t.type
  WHERE f.file_type <> 'none'),
ff AS (SELECT dataset_id, list_sort(list(DISTINCT file_type)) AS fe,
  list_sort(list(DISTINCT engine) FILTER (WHERE engine IS NOT NULL)) AS se FROM typed GROUP BY dataset_id),
extended AS (SELECT d.dataset_id AS id, d.dataset_origin AS origin, d.dataset_url AS url, d.title, d.keywords, d.author,
  d.date_creation, d.description,
  CASE WHEN len(coalesce(fe, [])) = 0 THEN ['none'] ELSE fe END AS file_extensions,
  CASE WHEN len(coalesce(se, [])) = 0 THEN ['unknown'] ELSE se END AS software_engines
  FROM datasets d LEFT JOIN ff ON d.dataset_id = ff.dataset_id)"""

FLAGS = ("has_protein", "has_nucleic", "has_glucid", "has_lipid", "has_water_ion")
DETAILED = f"""
g AS (SELECT dataset_id, arg_min(atom_number, file_seq) FILTER (WHERE atom_number IS NOT NULL) AS atom_number,
  {", ".join(f"coalesce(bool_or({f}), false) AS {f}" for f in FLAGS)} FROM gro GROUP BY dataset_id),
m AS (SELECT dataset_id, {", ".join(f"arg_min({c}, file_seq) FILTER (WHERE {c} IS NOT NULL) AS {c}"
  for c in ("dt", "nsteps", "temperature"))},
  {", ".join(f"coalesce(arg_min({c}, file_seq) FILTER (WHERE {c} NOT IN ('no', 'undefined')), 'none') AS {c}"
  for c in ("thermostat", "barostat"))} FROM mdp GROUP BY dataset_id),
facts AS (SELECT * FROM g JOIN m USING (dataset_id)),
detailed AS (SELECT e.*, {", ".join(f"facts.{c}" for c in
  ("atom_number", *FLAGS, "dt", "nsteps", "temperature", "thermostat", "barostat"))}
  FROM extended e LEFT JOIN facts ON e.id = facts.dataset_id WHERE list_contains(e.file_extensions, 'gro'))"""


def _cleaned(parts: list[str]) -> str:
    text = f"concat_ws(' ', {', '.join(parts)})"
    for word in ("None", "none", "Unknown", "n/a", "undefined"):
        text = f"replace({text}, '{word}', '')"
    return f"trim({text}, {BLANKS})"


TEXT_PARTS = [f"nullif({c}, '')" for c in ("title", "keywords", "description")]

DOCS = "docs AS (SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents)"


def _tf(stops: bool) -> str:
    keep = f"WHERE term NOT IN ({STOPS})" if stops else ""
    return f"""{DOCS},
tok AS (SELECT id, unnest({WORDS.format("text")}) AS term FROM docs),
tf AS (SELECT id, term, count(*) AS tf FROM tok {keep} GROUP BY id, term)"""


def _tfidf(stops: bool, limit: str = "LIMIT 10000") -> str:
    return f"""{_tf(stops)},
voc AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS ctf,
  ln((1.0 + (SELECT count(*) FROM docs)) / (1.0 + count(*))) + 1.0 AS idf
  FROM tf GROUP BY term ORDER BY ctf DESC, term {limit}),
raw AS (SELECT id, tf.term, tf * idf AS raw FROM tf JOIN voc ON tf.term = voc.term),
tfidf AS (SELECT id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS weight FROM raw)"""


def _hashed(name: str, raw: str, dim: int = 256) -> str:
    """Hashed unit vectors (id, dim, v) in single precision."""
    return f"""
{name}_b AS (SELECT id, CAST(('0x' || substr(md5(term), 1, 8))::BIGINT % {dim} AS INTEGER) AS dim,
  sum(CASE WHEN substr(md5(term), 9, 1) IN ('0','2','4','6','8','a','c','e') THEN raw ELSE -raw END) AS s
  FROM {raw} GROUP BY ALL),
{name}_n AS (SELECT *, sqrt(sum(s * s) OVER (PARTITION BY id)) AS norm FROM {name}_b),
{name} AS (SELECT id, dim, CAST(CAST(s / norm AS FLOAT) AS DOUBLE) AS v FROM {name}_n WHERE norm > 0)"""


def _sparse_hits(k: int) -> str:
    return f"""{_tfidf(True)}, {ctes("text_meta")},
qtok AS (SELECT CAST(item_id AS VARCHAR) AS id, unnest({WORDS.format("text")}) AS term FROM benchmark),
qtf AS (SELECT id, term, count(*) AS tf FROM qtok GROUP BY ALL),
qraw AS (SELECT id, qtf.term, tf * idf AS raw FROM qtf JOIN voc ON qtf.term = voc.term),
qw AS (SELECT id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS weight FROM qraw),
dots AS (SELECT qw.id AS query_id, t.id AS id, sum(qw.weight * t.weight) AS dot FROM qw JOIN tfidf t ON qw.term = t.term
  GROUP BY ALL),
sims AS (SELECT CAST(b.item_id AS VARCHAR) AS query_id, docs.id, round(coalesce(dot, 0.0), 9) AS similarity
  FROM benchmark b CROSS JOIN docs LEFT JOIN dots ON dots.query_id = CAST(b.item_id AS VARCHAR) AND dots.id = docs.id),
hits AS (SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank
  FROM sims QUALIFY rank <= {k})"""


def _hits(k: int, dim: int) -> str:
    return f"""{_tfidf(True, "")}, {ctes("text_meta")},
{_hashed("dv", "raw", dim)},
qtok AS (SELECT CAST(item_id AS VARCHAR) AS id, unnest({WORDS.format("text")}) AS term FROM benchmark),
qtf AS (SELECT id, term, count(*) AS tf FROM qtok WHERE term NOT IN ({STOPS}) GROUP BY ALL),
qraw AS (SELECT id, qtf.term, tf * idf AS raw FROM qtf JOIN voc ON qtf.term = voc.term),
{_hashed("qv", "qraw", dim)},
dl AS (SELECT id, sqrt(sum(v * v)) AS len FROM dv GROUP BY id),
ql AS (SELECT id, sqrt(sum(v * v)) AS len FROM qv GROUP BY id),
allq AS (SELECT CAST(item_id AS VARCHAR) AS query_id FROM benchmark),
dots AS (SELECT qv.id AS query_id, dv.id AS id, sum(qv.v * dv.v) AS dot FROM qv JOIN dv ON qv.dim = dv.dim GROUP BY ALL),
sims AS (SELECT allq.query_id, docs.id, round(coalesce(dot / (ql.len * dl.len), 0.0), 9) AS similarity
  FROM allq CROSS JOIN docs LEFT JOIN dots ON dots.query_id = allq.query_id AND dots.id = docs.id
  LEFT JOIN ql ON ql.id = allq.query_id LEFT JOIN dl ON dl.id = docs.id),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM sims
  QUALIFY rank <= {k}),
hits AS (SELECT query_id, rank, t.id, coalesce(title, 'No Title') AS title, coalesce(keywords, 'No Keywords') AS keywords,
  coalesce(date_creation, 'No Date') AS date_creation, coalesce(description, 'No Description') AS description,
  coalesce(author, 'No Authors') AS authors, 'No Software Engine' AS software_engine,
  coalesce(origin, 'No Origin') AS origin, coalesce(url, 'No URL') AS url,
  {R.format("similarity")} AS similarity, {R.format("1.0 - similarity")} AS distance
  FROM top t JOIN text_meta m ON t.id = m.id)"""


HITS = _hits(10, 256)


def _edges(threshold: float) -> str:
    return f"""{_tfidf(False)},
edges AS (SELECT a.id AS src, b.id AS dst, sum(a.weight * b.weight) AS weight FROM tfidf a JOIN tfidf b
  ON a.term = b.term AND a.id < b.id GROUP BY ALL HAVING sum(a.weight * b.weight) > {threshold}),
both_ways AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)"""


def _components(threshold: float) -> str:
    return f"""{_edges(threshold)},
reach(id, seen) AS (SELECT id, id FROM docs UNION SELECT r.id, b.dst FROM reach r JOIN both_ways b ON r.seen = b.src),
comp AS (SELECT id, min(seen) AS component FROM reach GROUP BY id)"""


PARTS = f"""{_components(0.7)}, {ctes("text_meta")},
parts AS (SELECT c.id, c.component AS cluster, m.title FROM comp c JOIN text_meta m ON c.id = m.id),
sizes AS (SELECT cluster, count(*) AS size FROM parts GROUP BY cluster),
largest AS (SELECT cluster, size, row_number() OVER (ORDER BY size DESC, cluster) AS rank FROM sizes
  QUALIFY rank <= 5)"""

POINTS = f"""points AS (SELECT CAST(vec_id AS VARCHAR) AS id,
  round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST({AXES[0]} AS DOUBLE[])), 9) AS x,
  round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST({AXES[1]} AS DOUBLE[])), 9) AS y FROM embeddings)"""
KNN = f"""{POINTS},
near AS (SELECT a.id, b.id AS neighbor, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) AS dist
  FROM points a JOIN points b ON a.id <> b.id),
knn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, neighbor) AS rank FROM near QUALIFY rank <= 10)"""
DBSCAN = f"""{POINTS},
reachable AS (SELECT a.id, b.id AS other FROM points a JOIN points b
  ON sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) <= {EPS}),
core AS (SELECT id FROM reachable GROUP BY id HAVING count(*) >= {MIN_PTS}),
links AS (SELECT r.id, r.other FROM reachable r JOIN core c ON r.id = c.id JOIN core d ON r.other = d.id),
walk(id, seen) AS (SELECT id, id FROM core UNION SELECT w.id, l.other FROM walk w JOIN links l ON w.seen = l.id),
labels AS (SELECT id, min(seen) AS label FROM walk GROUP BY id),
clustered AS (SELECT p.id, p.x, p.y, coalesce(l.label, b.label) AS label FROM points p LEFT JOIN labels l ON p.id = l.id
  LEFT JOIN (SELECT r.id, min(l2.label) AS label FROM reachable r JOIN labels l2 ON r.other = l2.id GROUP BY r.id) b
  ON p.id = b.id)"""

TOKENS = """turns AS (SELECT CAST(c.conv_id AS VARCHAR) AS id, c.turn AS pos,
  CAST(e.embedding AS DOUBLE[]) AS embedding FROM conversations c
  JOIN embeddings e ON e.vec_id = (c.conv_id * 8 + c.turn) % (SELECT count(*) FROM embeddings))"""
POOLED = f"""{TOKENS},
cells AS (SELECT id, unnest(embedding) AS v, unnest(range(len(embedding))) AS dim FROM turns),
pooled AS (SELECT id, CAST(dim AS INTEGER) AS dim, avg(v) AS v FROM cells GROUP BY id, dim)"""

PLOT = f"""{ctes("datasets", "files", "file_types")}, {EXTENDED},
plot AS (SELECT id AS idx, origin AS cluster_name, coalesce(title, 'None') AS title, coalesce(url, 'None') AS url,
  coalesce(description, 'None') AS description, coalesce(author, 'None') AS authors,
  coalesce(keywords, 'None') AS keywords, coalesce(origin, 'None') AS origin,
  split_part(coalesce(date_creation, 'None'), '-', 1) AS date_creation, software_engines[1] AS software_engine
  FROM extended)"""


def _vote(previous: str, name: str) -> str:
    """One synchronous round of label propagation."""
    return f"""
{name}_t AS (SELECT b.src AS id, p.label, count(*) AS n FROM both_ways b JOIN {previous} p ON b.dst = p.id GROUP BY ALL),
{name}_b AS (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS r FROM {name}_t),
{name} AS (SELECT p.id, coalesce(b.label, p.label) AS label FROM {previous} p
  LEFT JOIN (SELECT * FROM {name}_b WHERE r = 1) b ON p.id = b.id)"""


def _q(with_: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{with_}\n{select}"


def _lists(rest: str) -> str:
    return (
        "array_to_string(file_extensions, ',') AS file_extensions, "
        f"array_to_string(software_engines, ',') AS software_engines{rest}"
    )


BASIC = "id, origin, url, title, keywords, author, date_creation, description"


def sql() -> dict[str, str]:
    catalogue = f"{ctes('datasets', 'files', 'file_types')}, {EXTENDED}"
    facts = f"{ctes('datasets', 'files', 'file_types', 'gro', 'mdp')}, {EXTENDED}, {DETAILED}"
    flags = ", ".join(f"CASE WHEN {f} IS NULL THEN 'none' ELSE CAST({f} AS VARCHAR) END AS {f}" for f in FLAGS)
    fact_text = ", ".join(
        f"coalesce(CAST({c} AS VARCHAR), 'none') AS {c}" for c in ("atom_number", "nsteps", "thermostat", "barostat")
    )
    detailed_parts = [
        *TEXT_PARTS,
        "array_to_string(file_extensions, ' ')",
        "array_to_string(software_engines, ' ')",
        "'atom_number=' || coalesce(CAST(atom_number AS VARCHAR), 'none')",
        *[f"CASE WHEN {f} THEN '{f}' END" for f in FLAGS],
    ]
    metadata = {
        **{c: f"coalesce({c}, 'None')" for c in BASIC.split(", ")},
        **{
            c: f"'[\"' || array_to_string({c}, '\",\"') || '\"]'"
            for c in ("file_extensions", "software_engines")
        },
    }
    facets = " UNION ALL ".join(
        f"SELECT '{facet}' AS facet, {col} AS value, count(*) AS n FROM plot GROUP BY {col}"
        for facet, col in (("date", "date_creation"), ("software", "software_engine"), ("origin", "origin"))
    )
    prompt = PROMPT.replace("'", "''").replace("{used}", "Lipids").split("{titles}")
    return {
        "basic_level": _q(
            ctes("datasets"),
            "SELECT dataset_id AS id, dataset_origin AS origin, dataset_url AS url, title, keywords, author, "
            "date_creation, description FROM datasets",
        ),
        "extended_level": _q(catalogue, f"SELECT {BASIC}, {_lists('')} FROM extended"),
        "detailed_level": _q(
            facts,
            f"SELECT {BASIC}, {_lists('')}, atom_number, {', '.join(FLAGS)}, {R.format('dt')} AS dt, nsteps, "
            f"{R.format('temperature')} AS temperature, thermostat, barostat FROM detailed",
        ),
        "detailed_defaults": _q(facts, f"SELECT id, {fact_text}, {flags} FROM detailed"),
        "valid_facts": _q(
            facts,
            f"SELECT dataset_id, file_seq, {R.format('dt')} AS dt, nsteps, {R.format('temperature')} AS temperature, "
            "thermostat, barostat FROM mdp WHERE dataset_id IN "
            "(SELECT id FROM extended WHERE list_contains(file_extensions, 'gro'))",
        ),
        "text_basic": _q(ctes("text_meta"), f"SELECT id, {_cleaned(TEXT_PARTS)} AS text FROM text_meta"),
        "text_detailed": _q(facts, f"SELECT id, {_cleaned(detailed_parts)} AS text FROM detailed"),
        "json_roundtrip": _q(ctes("text_meta"), f"SELECT {BASIC} FROM text_meta"),
        "metadata_map": _q(
            catalogue,
            " UNION ALL ".join(f"SELECT id, '{c}' AS key, {v} AS value FROM extended" for c, v in metadata.items()),
        ),
        "id_prefixes": _q(
            ctes("datasets"),
            "SELECT dataset_id || '_' || dataset_origin AS id, dataset_id AS idx, "
            "split_part(date_creation, '-', 1) AS year FROM datasets",
        ),
        "plot_points": _q(PLOT, "SELECT * FROM plot"),
        "facet_counts": _q(PLOT, facets),
        "title_search": _q(PLOT, "SELECT idx, title FROM plot WHERE contains(lower(title), 'urgent set')"),
        "tokens": _q(_tf(True), "SELECT id, term, tf FROM tf"),
        "doc_freq": _q(
            _tf(True), "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM tf GROUP BY term"
        ),
        "vocabulary_terms": _q(
            _tfidf(True),
            f"SELECT term, df, ctf AS tf, {R.format('idf')} AS idf, "
            'row_number() OVER (ORDER BY df DESC, term) - 1 AS "index" FROM voc',
        ),
        "tfidf_weights": _q(_tfidf(True), f"SELECT id, term, {R.format('weight')} AS weight FROM tfidf"),
        "embed_hashing": _q(
            f"{_tfidf(True, '')}, {_hashed('dv', 'raw')}", f"SELECT id, dim, {R.format('v')} AS value FROM dv WHERE round(v, 6) <> 0"
        ),
        "pool_mean": _q(POOLED, f"SELECT id, dim, {R.format('v')} AS value FROM pooled"),
        "pool_cls": _q(
            TOKENS,
            f"SELECT id, CAST(dim AS INTEGER) AS dim, {R.format('v')} AS value FROM (SELECT id, unnest(embedding) AS v, "
            "unnest(range(len(embedding))) AS dim FROM turns WHERE pos = 0)",
        ),
        "normalize": _q(
            POOLED,
            f"SELECT id, dim, {R.format('v / sqrt(sum(v * v) OVER (PARTITION BY id))')} AS value FROM pooled",
        ),
        "cosine_turns": _q(
            f"""{TOKENS},
normed AS MATERIALIZED (SELECT id, pos, embedding, sqrt(list_inner_product(embedding, embedding)) AS norm FROM turns),
c AS (SELECT id, pos, norm, list_inner_product(embedding, lead(embedding) OVER w) / (norm * lead(norm) OVER w) AS cosine,
  lead(pos) OVER w AS after FROM normed WINDOW w AS (PARTITION BY id ORDER BY pos))""",
            f"SELECT id, pos, {R.format('cosine')} AS cosine, {R.format('1.0 - cosine')} AS distance, "
            f"{R.format('norm')} AS norm FROM c WHERE after = pos + 1",
        ),
        "cosine_topk": _q(
            """v AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT a.id AS query_id, b.id, round(list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e))
  * sqrt(list_inner_product(b.e, b.e))), 9) AS similarity FROM v a CROSS JOIN v b),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s QUALIFY rank <= 10)""",
            f"SELECT query_id, id, {R.format('similarity')} AS similarity, {R.format('1.0 - similarity')} AS distance, "
            "rank FROM t",
        ),
        "search_hits": _q(HITS, "SELECT * FROM hits"),
        "detail_view": _q(
            HITS,
            "SELECT query_id, url, origin, date_creation, authors, title, keywords, software_engine, description, "
            "url AS link FROM hits WHERE rank = 1",
        ),
        "hit_list": _q(HITS, "SELECT query_id, rank, title, similarity FROM hits"),
        "sim_edges_dense": _q(
            """v AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT a.id AS src, b.id AS dst, list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e))
  * sqrt(list_inner_product(b.e, b.e))) AS weight FROM v a JOIN v b ON a.id < b.id)""",
            f"SELECT src, dst, {R.format('weight')} AS weight FROM s WHERE weight > 0.3",
        ),
        "sim_edges_sparse_09": _q(_edges(0.9), f"SELECT src, dst, {R.format('weight')} AS weight FROM edges"),
        "sim_edges_sparse_07": _q(_edges(0.7), f"SELECT src, dst, {R.format('weight')} AS weight FROM edges"),
        "graph_counts": _q(
            _edges(0.9), "SELECT (SELECT count(*) FROM docs) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges"
        ),
        "components": _q(
            _components(0.9), "SELECT id, component FROM comp WHERE id IN (SELECT id FROM docs)", recursive=True
        ),
        "lpa_rounds3": _q(
            f"{_edges(0.9)}, l0 AS (SELECT id, id AS label FROM docs), "
            f"{_vote('l0', 'l1')}, {_vote('l1', 'l2')}, {_vote('l2', 'l3')}",
            "SELECT id, label FROM l3",
        ),
        "cluster_sizes": _q(PARTS, "SELECT cluster, size FROM sizes", recursive=True),
        "cluster_count": _q(PARTS, "SELECT count(DISTINCT cluster) AS n_groups FROM parts", recursive=True),
        "distinct_clusters": _q(PARTS, "SELECT DISTINCT cluster FROM parts", recursive=True),
        "largest_communities": _q(PARTS, "SELECT * FROM largest", recursive=True),
        "top5_report": _q(
            PARTS,
            """SELECT rank, 0 AS line_no, '' AS id, 'Cluster ' || rank || ' (Size: ' || size || ')' AS line FROM largest
UNION ALL SELECT l.rank, 1, p.id, p.id || ' - ' || coalesce(p.title, 'No Title') FROM parts p JOIN largest l
  ON p.cluster = l.cluster
UNION ALL SELECT rank, 2, '', '' FROM largest""",
            recursive=True,
        ),
        "sample10": _q(
            PARTS,
            "SELECT id, cluster, title, row_number() OVER (PARTITION BY cluster ORDER BY md5(id || ':7'), id) AS sample_no "
            "FROM parts QUALIFY sample_no <= 10",
            recursive=True,
        ),
        "titles_per_cluster": _q(
            PARTS,
            "SELECT cluster, id, coalesce(title, 'Unknown Title') AS title FROM parts",
            recursive=True,
        ),
        "cluster_terms": _q(
            f"""{PARTS},
ct AS (SELECT cluster, unnest({WORDS.format("title")}) AS term FROM parts),
cc AS (SELECT cluster, term, count(*) AS tf FROM ct WHERE term NOT IN ({STOPS}, {_in(BANNED_WORDS)}) GROUP BY ALL),
ff AS (SELECT term, sum(tf) AS f FROM cc GROUP BY term),
aa AS (SELECT sum(tf) / count(DISTINCT cluster) AS a FROM cc)""",
            f"SELECT cluster, cc.term, tf, {R.format('tf * ln(1.0 + (SELECT a FROM aa) / f)')} AS score "
            "FROM cc JOIN ff ON cc.term = ff.term",
            recursive=True,
        ),
        "naming_prompts": _q(
            PARTS,
            f"SELECT cluster, '{prompt[0]}' || left(string_agg(coalesce(title, 'Unknown Title'), ', ' ORDER BY id), 800) "
            f"|| '{prompt[1]}' AS prompt FROM parts GROUP BY cluster",
            recursive=True,
        ),
        "row_counts": _q(
            facts,
            "SELECT 'datasets' AS stage, count(*) AS n_rows FROM datasets UNION ALL SELECT 'files', count(*) FROM files "
            "UNION ALL SELECT 'extended', count(*) FROM extended UNION ALL SELECT 'detailed', count(*) FROM detailed "
            "UNION ALL SELECT 'valid_facts', count(*) FROM mdp WHERE dataset_id IN "
            "(SELECT id FROM extended WHERE list_contains(file_extensions, 'gro'))",
        ),
        "level_roundtrip": _q(catalogue, f"SELECT {BASIC}, {_lists('')} FROM extended"),
        "catalogue_roundtrip": _q(
            facts,
            " UNION ALL ".join(f"SELECT '{t}' AS stage, count(*) AS n_rows FROM {t}" for t in ("datasets", "files", "gro", "mdp")),
        ),
        "vector_store_roundtrip": "SELECT CAST(vec_id AS VARCHAR) AS id, CAST(vec_id AS VARCHAR) AS idx, "
        + R.format("sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))")
        + " AS norm FROM embeddings",
        "graph_export": _q(_edges(0.98), f"SELECT src, dst, {R.format('weight')} AS weight FROM edges"),
        "report_lines": _q(
            PARTS,
            """SELECT line, count(*) AS n FROM (SELECT 'Cluster ' || rank || ' (Size: ' || size || ')' AS line FROM largest
UNION ALL SELECT unnest(string_split(p.id || ' - ' || coalesce(p.title, 'No Title'), chr(10))) FROM parts p JOIN largest l
  ON p.cluster = l.cluster
UNION ALL SELECT '' FROM largest) GROUP BY line""",
            recursive=True,
        ),
        "store_search_hashing": _q(_hits(50, 256), "SELECT query_id, rank, title, similarity FROM hits"),
        "store_search_tfidf": _q(
            _sparse_hits(50), f"SELECT query_id, rank, coalesce(title, 'No Title') AS title, {R.format('similarity')} AS similarity "
            "FROM hits JOIN text_meta USING (id)"),
        "spring_forces": _q(
            f"""{DOCS},
placed AS (SELECT id, CAST('0x' || left(md5(id || ':x:0'), 8) AS BIGINT) / 4294967296.0 AS x,
  CAST('0x' || left(md5(id || ':y:0'), 8) AS BIGINT) / 4294967296.0 AS y FROM docs),
pushes AS (SELECT a.id, 0.08 * 0.08 / greatest((a.x - b.x) ** 2 + (a.y - b.y) ** 2, 1e-4) AS c, a.x - b.x AS dx, a.y - b.y AS dy
  FROM placed a JOIN placed b ON a.id <> b.id),
forces AS (SELECT id, sum(c * dx) AS rx, sum(c * dy) AS ry FROM pushes GROUP BY id)""",
            f"SELECT id, {R.format('x')} AS x, {R.format('y')} AS y, round(coalesce(rx, 0), 4) + 0.0 AS rx, "
            "round(coalesce(ry, 0), 4) + 0.0 AS ry FROM placed LEFT JOIN forces USING (id)"),
        "positions": _q(DOCS, "SELECT id, row_number() OVER (ORDER BY id) - 1 AS position FROM docs"),
        "knn10": _q(KNN, f"SELECT id, neighbor, {R.format('dist')} AS dist, rank FROM knn"),
        "nn_label": _q(KNN, "SELECT id, neighbor AS label FROM knn WHERE rank = 1"),
        "knn_components": _q(
            f"""{KNN},
nn AS (SELECT id, neighbor FROM knn WHERE rank = 1 UNION ALL SELECT neighbor, id FROM knn WHERE rank = 1),
walk(id, seen) AS (SELECT id, id FROM points UNION SELECT w.id, n.neighbor FROM walk w JOIN nn n ON w.seen = n.id)""",
            "SELECT id, min(seen) AS label FROM walk GROUP BY id",
            recursive=True,
        ),
        "dbscan": _q(DBSCAN, "SELECT id, label FROM clustered", recursive=True),
        "dbscan_clusters": _q(
            DBSCAN,
            "SELECT id, CASE WHEN label IS NULL THEN -1 ELSE (SELECT count(DISTINCT label) FROM labels l "
            "WHERE l.label < clustered.label) END AS cluster FROM clustered",
            recursive=True,
        ),
        "centroids_bbox": _q(
            DBSCAN,
            f"""SELECT label, count(*) AS size, {R.format('avg(x)')} AS centroid_x, {R.format('avg(y)')} AS centroid_y,
{R.format('min(x)')} AS min_x, {R.format('max(x)')} AS max_x, {R.format('min(y)')} AS min_y, {R.format('max(y)')} AS max_y
FROM clustered WHERE label IS NOT NULL GROUP BY label""",
            recursive=True,
        ),
    }
