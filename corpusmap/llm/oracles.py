"""The registered queries as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from corpusmap.llm.centroids import CENTROIDS, DIMS, ROUNDS, SEED
from corpusmap.llm.host_rules import HOST_LIMIT, HOST_RULES
from corpusmap.llm.licences import ENDS, HOLDER, RULES, known

# Documents with the counts and base rules of the host rules.
MEASURED = r"""
texts AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT doc_id, source, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM texts),
grams AS (
  SELECT doc_id, unnest(list_transform(range(1, len(words) - 3), lambda i: {'i': i,
    'g': concat_ws(' ', words[i], words[i+1], words[i+2], words[i+3], words[i+4])}), recursive := true) FROM split),
placed AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams),
starts AS (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS step
  FROM placed WHERE n > 1),
repeats AS (SELECT doc_id, sum(step) AS n_repeat_words FROM starts GROUP BY doc_id),
counted AS (
  SELECT doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines FROM split),
measured AS (
  SELECT c.*, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    n_words < 10 OR coalesce(n_repeat_words, 0) * 100 > n_words * 20 AS base_failed,
    n_symbols * 100 > word_chars * 10 AS symbols, n_dup_lines * 100 > n_lines * 30 AS dup_lines,
    word_chars < n_words * 2 OR word_chars > n_words * 20 AS word_length
  FROM counted c LEFT JOIN repeats USING (doc_id))"""


def _hosts() -> str:
    counts = ", ".join(f"count(*) FILTER ({r}) AS {r}_failed" for r in HOST_RULES)
    moments = ", ".join(
        f"avg({r}_failed / n_docs) AS {r}_mean, var_pop({r}_failed / n_docs) AS {r}_var" for r in HOST_RULES
    )
    weights = ", ".join(
        f"CASE WHEN {r}_var > 0 THEN least(greatest({r}_mean * (1 - {r}_mean) / {r}_var - 1, 1), 1e6) ELSE 1e6 END"
        f" AS {r}_weight" for r in HOST_RULES
    )
    verdicts = ", ".join(
        f"({r}_failed + {r}_mean * {r}_weight) / (n_docs + {r}_weight) > {HOST_LIMIT} AS {r}_verdict"
        for r in HOST_RULES
    )
    return f"""
hosts AS (SELECT source, count(*) AS n_docs, {counts} FROM measured GROUP BY source),
moments AS (SELECT {moments} FROM hosts),
weights AS (SELECT *, {weights} FROM moments),
verdicts AS (SELECT source, {verdicts} FROM hosts, weights)"""


def op6() -> str:
    rejects = " OR ".join(f"({r} AND {r}_verdict)" for r in HOST_RULES)
    return f"""WITH {MEASURED.strip()}, {_hosts().strip()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR {rejects}) AS kept
FROM measured m JOIN verdicts v ON m.source IS NOT DISTINCT FROM v.source"""


def op3() -> str:
    table = known()
    keys = ", ".join(f"'{k}'" for k in table)
    ids = ", ".join(f"'<{v}>'" for v in table.values())

    def sequence(text: str) -> str:
        norm = f"regexp_replace(trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')), '{HOLDER}', 'copyright')"
        forms = f"list_transform(regexp_split_to_array({text}, '{ENDS}'), lambda s: {norm})"
        found = f"list_transform({forms}, lambda s: [{ids}][list_position([{keys}], s)])"
        return f"coalesce(array_to_string(list_filter({found}, lambda x: x IS NOT NULL), ''), '')"

    steps = [f"s0 AS (SELECT doc_id, {sequence('a')} AS lines, {sequence('b')} AS flow, lines AS x, flow AS y FROM texts)"]
    for k, (_, seq) in enumerate(RULES):
        want = "".join(f"<{i}>" for i in seq.split())
        steps.append(
            f"s{k + 1} AS (SELECT * REPLACE (replace(x, '{want}', '|') AS x, replace(y, '{want}', '|') AS y), "
            f"contains(x, '{want}') AS a{k}, contains(y, '{want}') AS b{k} FROM s{k})"
        )
    names = [
        "[" + ", ".join(f"CASE WHEN {v}{k} THEN '{name}' END" for k, (name, _) in enumerate(RULES)) + "]" for v in "ab"
    ]
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS a,
  regexp_replace(coalesce(text, ''), '([^\n])\n([^\n])', '\1 \2', 'g') AS b FROM documents),
{", ".join(steps)},
named AS (SELECT doc_id, CASE WHEN length(flow) > length(lines) THEN flow ELSE lines END AS sentences,
  list_sort(list_distinct(list_filter(list_concat({names[0]}, {names[1]}), lambda n: n IS NOT NULL))) AS names
  FROM s{len(RULES)})
SELECT doc_id, sentences, CASE WHEN len(names) > 0 THEN array_to_string(names, ',') ELSE 'unknown' END AS licences
FROM named WHERE sentences <> ''"""


def op12() -> str:
    distance = "CAST(list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i]))) AS BIGINT)"

    def assigned(i: int) -> str:
        return f"""
met{i} AS (SELECT k.row, c.c, {distance} AS d FROM kept k, c{i} c),
a{i} AS MATERIALIZED (SELECT row, min(struct_pack(d := d, c := c)) AS best FROM met{i} GROUP BY row)"""

    rounds = ""
    for i in range(ROUNDS):
        rounds += f"""{assigned(i)},
sums{i} AS (SELECT best.c AS c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n
  FROM a{i} JOIN kept USING (row), range(1, 65) AS t(i) GROUP BY best.c, i),
means{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM sums{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN means{i} m USING (c)),"""
    return f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id,
    list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS} AND len(embedding) = {DIMS}),
named AS (SELECT v, row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c FROM kept),
c0 AS MATERIALIZED (SELECT * FROM named WHERE c < {CENTROIDS}),{rounds}{assigned(ROUNDS)},
placed AS (SELECT vec_id, best.c AS c, best.d AS distance FROM a{ROUNDS} JOIN kept USING (row))
SELECT vec_id, CAST(c AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(f.v, ',')) AS centroid_sha256
FROM placed JOIN c{ROUNDS} f USING (c)"""


def sql() -> dict[str, str]:
    return {"op3_licences": op3(), "op6_host_rules": op6(), "op12_centroid_clusters": op12()}
