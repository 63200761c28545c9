"""DuckDB texts of the operators that SQL can express, written from the contracts."""

from __future__ import annotations

#: CRC-32 of the short ASCII string {s}, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen({s}) + 1), lambda i: ascii(substr({s}, i::BIGINT, 1))::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""


def _edited(path: str, price: str, edit: str) -> str:
    """A path is its cost in six digits, then its audit, so that the least string is the answer."""
    return f"(lpad((substr({path}, 1, 6)::INT + {price})::VARCHAR, 6, '0') || substr({path}, 7) || '{edit}')"


def _moved(source: str, initial: str) -> str:
    """Least path over a row that becomes a turn with that initial, by Keep or Rerole."""
    keep = f"CASE WHEN r.fault IN (0, 3) AND r.role[1] = '{initial}' THEN {_edited(source, 'r.charge', 'K')} END"
    change = "" if initial == "s" else f", CASE WHEN r.fault IN (0, 3) THEN {_edited(source, '1 + r.charge', 'R')} END"
    return f"least({keep}{change}, NULL)"


def op11() -> str:
    q = {
        "q0": _edited("p.p0", "2", "D"),
        "q1": f"least({_edited('p.p1', '2', 'D')}, {_moved('p.p0', 's')})",
        "q2": f"least({_edited('p.p2', '2', 'D')}, {_moved('p.p0', 'u')}, {_moved('p.p1', 'u')}, {_moved('p.p3', 'u')})",
        "q3": f"least({_edited('p.p3', '2', 'D')}, {_moved('p.p2', 'a')})",
    }
    inserted = "least(q2, " + ", ".join(_edited(x, "5", "I") for x in ("q0", "q1", "q3")) + ")"
    return rf"""
    WITH RECURSIVE base AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
    crc AS (SELECT k, {_CRC.format(s="k")} % 20 AS f FROM (SELECT DISTINCT k FROM base)),
    harm AS (
        SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE WHEN f = 1 THEN '' WHEN f = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
            unnest(CASE WHEN f = 3 THEN [1, 2] ELSE [1] END) AS copy
        FROM base JOIN crc USING (k) WHERE f <> 0),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
            row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
            rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM harm),
    rows_of AS (
        SELECT *, CASE WHEN fault = 3 THEN 5 ELSE 0 END AS charge, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair
        FROM (SELECT *, CASE WHEN bare = '' THEN 1 WHEN seen > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM placed)),
    counted AS (
        SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
            count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_of GROUP BY conv_id),
    paths AS (
        SELECT conv_id, 0::BIGINT AS i, '000000' AS p0, NULL::VARCHAR AS p1, '000005I' AS p2, NULL::VARCHAR AS p3 FROM counted
        UNION ALL
        SELECT conv_id, i, q0, q1, {inserted}, least(q3, {_edited("q2", "5", "I")})
        FROM (SELECT p.conv_id, r.i, {", ".join(f"{v} AS {k}" for k, v in q.items())} FROM paths p JOIN rows_of r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1)),
    best AS (
        SELECT c.*, least(p0, p3) AS path FROM counted c JOIN paths p ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.i = c.n),
    edits AS (
        SELECT conv_id, k, substr(path, k, 1) AS edit FROM (SELECT conv_id, path, unnest(range(7, length(path) + 1)) AS k FROM best)),
    steps AS (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS i FROM edits),
    turns AS (
        SELECT s.conv_id, s.k, s.edit, CASE WHEN s.edit = 'I' THEN '' ELSE r.text END AS text, r.role, row_number() OVER (PARTITION BY s.conv_id ORDER BY s.k) AS place
        FROM steps s LEFT JOIN rows_of r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i WHERE s.edit <> 'D'),
    led AS (SELECT *, max(CASE WHEN place = 1 AND edit = 'K' AND role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS lead FROM turns),
    repaired AS (
        SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS whole FROM led GROUP BY conv_id)
    SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
        coalesce(substr(path, 1, 6)::BIGINT, 0) AS cost, coalesce(substr(path, 7), '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired w ON w.conv_id IS NOT DISTINCT FROM o.conv_id
    """


def op13(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """For vec_ids that occur once and vectors of one length, a multiple of parts."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
    d{r} AS MATERIALIZED (SELECT x.vec_id, x.part, e.entry, sum((x.v - e.v) * (x.v - e.v))::BIGINT AS d FROM x JOIN e{r} e ON e.part = x.part AND e.pos = x.pos GROUP BY ALL),
    a{r} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, d * {entries} + entry) AS entry, min(d) AS d FROM d{r} GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""
    m{r} AS (SELECT x.part, a.entry, x.pos, floor(sum(x.v)::DOUBLE / count(*))::BIGINT AS v FROM x JOIN a{r} a ON a.vec_id = x.vec_id AND a.part = x.part GROUP BY ALL),
    e{r + 1} AS MATERIALIZED (SELECT e.part, e.entry, e.pos, coalesce(m.v, e.v) AS v FROM e{r} e LEFT JOIN m{r} m ON m.part = e.part AND m.entry = e.entry AND m.pos = e.pos)""")
    return f"""
    WITH good AS (
        SELECT vec_id, label, embedding, len(embedding) // {parts} AS width FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)),
    x AS MATERIALIZED (
        SELECT vec_id, (i - 1) // width AS part, (i - 1) % width AS pos, floor(embedding[i]::DOUBLE * {scale})::BIGINT AS v
        FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM good)),
    firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM good ORDER BY vec_id LIMIT {entries}),
    e0 AS MATERIALIZED (SELECT part, entry, pos, v FROM x JOIN firsts USING (vec_id)),{",".join(steps)},
    coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY 1)
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
        (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) FROM e{rounds}) AS codebooks_sha256
    FROM coded JOIN good USING (vec_id)
    """
