"""Building blocks for the SQL side of the correctness check.

Each view is plain SQL over the driver's tables, written independently of the Spark
operators. `complete` puts the views a query mentions in front of it.
"""

from __future__ import annotations

import re

from turnloom.functions import labels as L


def _case(column: str, table: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE {column} {whens} ELSE {default} END"


def extended(column: str) -> str:
    return _case(column, L.members(L.EXTENDED_GROUPS), "'other'")


def core(column: str, default: str = "NULL") -> str:
    return _case(column, L.members(L.CORE_GROUPS), default)


def short(column: str) -> str:
    return _case(column, L.GROUP_ABBREVIATIONS, column)


def codes(column: str, default: str = "['NA']") -> str:
    cleaned = (
        f"list_filter(list_transform(string_split(coalesce({column}, ''), ','), lambda c: trim(c)),"
        " lambda c: c NOT IN ('', 'nan', 'NaN', 'None'))"
    )
    return f"CASE WHEN len({cleaned}) = 0 THEN {default} ELSE {cleaned} END"


_ISLANDS = {
    "patient": "patient", "therapist": "therapist", "either": "patient OR therapist",
    "neither": "NOT (patient OR therapist)", "patient_rest": "NOT patient",
    "therapist_rest": "NOT therapist",
}

_flags = ", ".join(f"({cond}) AS is_{name}" for name, cond in _ISLANDS.items())
_edges = ", ".join(
    f"(is_{n} AND NOT coalesce(lag(is_{n}) OVER w, false)) AS {n}_opens, "
    f"(is_{n} AND NOT coalesce(lead(is_{n}) OVER w, false)) AS {n}_closes"
    for n in _ISLANDS
)
_runs = ", ".join(
    f"({c} IS DISTINCT FROM lag({c}) OVER w) AS {n}_opens, "
    f"({c} IS DISTINCT FROM lead({c}) OVER w) AS {n}_closes"
    for n, c in (("group", "da_group"), ("label", "proc_da"))
)


def _bounds(n: str, inside: str) -> str:
    return (
        f"CASE WHEN {inside} THEN max(CASE WHEN {n}_opens THEN pos END) OVER "
        f"(PARTITION BY source_file ORDER BY pos ROWS UNBOUNDED PRECEDING) END AS {n}_start, "
        f"CASE WHEN {inside} THEN min(CASE WHEN {n}_closes THEN pos END) OVER (PARTITION BY "
        f"source_file ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END AS {n}_end"
    )


_all_bounds = ", ".join(
    [_bounds(n, f"is_{n}") for n in _ISLANDS] + [_bounds(n, "true") for n in ("group", "label")]
)


def _block_codes(target: str) -> str:
    return f"""
      SELECT source_file, {target}_start AS block_start, code,
             row_number() OVER (PARTITION BY source_file, {target}_start ORDER BY min(pos * 100 + i)) - 1
               AS code_index
      FROM (SELECT source_file, {target}_start, pos, unnest({codes(target + '_code')}) AS code,
                   generate_subscripts({codes(target + '_code')}, 1) AS i
            FROM hub WHERE {target}_start IS NOT NULL)
      GROUP BY source_file, {target}_start, code"""


def _grams(source: str, partition: str, sizes: tuple[int, ...], keep: str) -> str:
    leads = ", ".join(
        f"lead(label, {i}) OVER (PARTITION BY {partition} ORDER BY pos) AS l{i}"
        for i in range(1, max(sizes))
    )
    parts = []
    for n in sizes:
        gram = " || ' -> ' || ".join(["label"] + [f"l{i}" for i in range(1, n)])
        where = f"WHERE l{n - 1} IS NOT NULL" if n > 1 else ""
        parts.append(f"SELECT {keep}, {n} AS n, {gram} AS ngram FROM t {where}")
    lead_list = f", {leads}" if leads else ""
    return f"WITH t AS (SELECT *{lead_list} FROM {source}) " + " UNION ALL ".join(parts)


def context(target: str, rows: int) -> str:
    """(block, region, row) triples of one target."""
    return f"""
      SELECT h.*, b.block_start, CASE WHEN h.pos < b.block_start THEN 'pre'
             WHEN h.pos > b.block_end THEN 'post' ELSE 'core' END AS region
      FROM hub h JOIN {target}_blocks b ON h.source_file = b.source_file
       AND h.pos BETWEEN b.block_start - {rows} AND b.block_end + {rows}"""


VIEWS: dict[str, str] = {
    "event_rows": """
      SELECT concat('sessionT', CAST(user_id % 5 AS VARCHAR), '_with_AC',
               lpad(CAST(user_id % 20 AS VARCHAR), 2, '0'), '_', CAST(user_id AS VARCHAR), '.csv') AS source_file,
             event_id, ts, strftime(ts, '%-H:%M:%S') AS timestamp,
             CASE WHEN k % 3 = 0 THEN 'Therapist' ELSE 'Patient' END AS speaker,
             event_type || ' ' || CAST(k AS VARCHAR) AS spoken_text,
             CASE WHEN k % 10 = 0 THEN 'Acknowledge-Backchannel' WHEN k % 17 = 0 THEN 'I-'
                  WHEN k % 23 = 0 THEN 'Quotation' WHEN event_type = 'view' THEN 'Statement-non-opinion'
                  WHEN event_type = 'click' THEN 'Statement-opinion' WHEN event_type = 'error' THEN 'Hedge'
                  WHEN event_type = 'signup' THEN 'Wh-Question' ELSE 'Yes-answers' END AS proc_da,
             value > 60 AS patient, (value < 12 OR value > 90) AS therapist,
             CASE WHEN value <= 60 THEN NULL WHEN k % 7 = 0 THEN 'IAI, VLD' WHEN k % 2 = 0 THEN 'BCS'
                  WHEN k % 5 = 0 THEN 'FTA' ELSE 'FSU' END AS patient_code,
             CASE WHEN value >= 12 AND value <= 90 THEN NULL WHEN k % 7 = 0 THEN 'ERT, IDR'
                  WHEN k % 2 = 0 THEN 'STK' WHEN k % 5 = 0 THEN '' ELSE 'HPM' END AS therapist_code
      FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)""",
    "all_rows": """
      SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY ts, event_id) - 1 AS pos
      FROM event_rows""",
    "hub": f"""
      WITH da AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY ts, event_id) - 1 AS pos,
                         {extended('proc_da')} AS da_group
                  FROM event_rows WHERE proc_da <> 'I-'),
           flags AS (SELECT *, {_flags} FROM da),
           edges AS (SELECT *, {_edges}, {_runs} FROM flags
                     WINDOW w AS (PARTITION BY source_file ORDER BY pos))
      SELECT source_file, pos, speaker, spoken_text, proc_da, da_group, patient, therapist,
             patient_code, therapist_code, timestamp,
             regexp_extract(source_file, '(.)_with', 1) AS marker_id,
             regexp_extract(source_file, 'T([0-9]+)', 1) AS rater, {_all_bounds} FROM edges""",
    "patient_blocks": """
      SELECT source_file, patient_start AS block_start, max(patient_end) AS block_end, count(*) AS n_rows
      FROM hub WHERE patient_start IS NOT NULL GROUP BY ALL""",
    "therapist_blocks": """
      SELECT source_file, therapist_start AS block_start, max(therapist_end) AS block_end, count(*) AS n_rows
      FROM hub WHERE therapist_start IS NOT NULL GROUP BY ALL""",
    "patient_codes": _block_codes("patient"),
    "therapist_codes": _block_codes("therapist"),
    "seqs": f"""
      SELECT source_file, pos, cls, seq, {short('da_group')} AS label, last - pos + 1 AS run_length,
             proc_da, da_group
      FROM (SELECT *, least(group_end, coalesce(seq_end, group_end)) AS last FROM (
              SELECT *, 'patient' AS cls, patient_start AS seq, patient_end AS seq_end FROM hub
              UNION ALL SELECT *, 'therapist', therapist_start, therapist_end FROM hub
              UNION ALL SELECT *, 'neither', neither_start, neither_end FROM hub
              UNION ALL SELECT *, 'transcript', 0, NULL FROM hub))
      WHERE seq IS NOT NULL AND pos = greatest(group_start, seq)""",
    "grams": _grams("seqs", "source_file, cls, seq", (2, 3, 4, 5), "source_file, cls, seq"),
    "levels": """
      WITH tagged AS (
        SELECT 'importance' AS level, CASE cls WHEN 'neither' THEN 'non_important'
                 ELSE cls || '_important' END AS grp, n, ngram FROM grams WHERE cls <> 'transcript'
        UNION ALL SELECT 'transcripts', source_file, n, ngram FROM grams WHERE cls = 'transcript'
        UNION ALL SELECT 'therapists', 'therapist_' || regexp_extract(source_file, '(.)_with', 1), n, ngram
                  FROM grams WHERE cls = 'transcript'
        UNION ALL SELECT c || '_codes', 'non_important', n, ngram
                  FROM grams, (VALUES ('patient'), ('therapist')) AS v(c) WHERE cls = 'neither'
        UNION ALL SELECT 'patient_codes', 'patient_' || code, n, ngram FROM grams g
                  JOIN patient_codes c ON g.source_file = c.source_file AND g.seq = c.block_start
                  WHERE cls = 'patient' AND code <> 'NA'
        UNION ALL SELECT 'therapist_codes', 'therapist_' || code, n, ngram FROM grams g
                  JOIN therapist_codes c ON g.source_file = c.source_file AND g.seq = c.block_start
                  WHERE cls = 'therapist' AND code <> 'NA')
      SELECT level, grp AS "group", n, ngram, count(*) AS cnt FROM tagged GROUP BY ALL""",
    "level_freq": """
      SELECT *, cnt / sum(cnt) OVER (PARTITION BY level, "group", n) AS freq FROM levels""",
}


def add_view(name: str, sql: str) -> None:
    if name in VIEWS:
        raise ValueError(f"view {name} is defined twice")
    VIEWS[name] = sql


def _mentioned(sql: str) -> list[str]:
    return [name for name in VIEWS if re.search(rf"\b{name}\b", sql)]


def complete(sql: str) -> str:
    """Prefix the views a query uses, dependencies first."""
    ordered: list[str] = []

    def visit(name: str, trail: tuple[str, ...]) -> None:
        if name in trail or name in ordered:
            return
        for needed in _mentioned(VIEWS[name]):
            visit(needed, (*trail, name))
        ordered.append(name)

    for name in _mentioned(sql):
        visit(name, ())
    if not ordered:
        return sql
    views = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in ordered)
    body = sql.strip()
    own = re.match(r"WITH( RECURSIVE)?\b", body, re.IGNORECASE)
    if own:
        return f"WITH{own.group(1) or ''} {views},\n{body[own.end():].lstrip()}"
    return f"WITH {views}\n{body}"


def chi2_tail(x: str, dof: str) -> str:
    """P(X >= x) through the power series of the lower incomplete gamma function."""
    h = f"(({x}) / 2.0)"
    a = f"(({dof}) / 2.0)"
    series = (
        f"list_sum(list_transform(range(0, 1500), lambda i: "
        f"exp((i + {a}) * ln({h}) - {h} - lgamma({a} + i + 1))))"
    )
    return (
        f"CASE WHEN ({x}) IS NULL OR ({dof}) IS NULL THEN NULL WHEN {h} <= 0 THEN 1.0 "
        f"WHEN {h} > 500 + {a} THEN 0.0 ELSE least(1.0, greatest(0.0, 1.0 - {series})) END"
    )


def corrected(source: str, family: str) -> str:
    """Benjamini-Hochberg over `p_value` of a source relation."""
    return f"""
      SELECT *, CASE WHEN p_value IS NOT NULL THEN least(1.0, min(p_value * m / rank) OVER (
               PARTITION BY {family}, p_value IS NULL ORDER BY p_value DESC RANGE UNBOUNDED PRECEDING)) END AS p_fdr
      FROM (SELECT *, count(p_value) OVER (PARTITION BY {family}) AS m,
                   count(p_value) OVER (PARTITION BY {family}, p_value IS NULL ORDER BY p_value
                     RANGE UNBOUNDED PRECEDING) AS rank FROM {source})"""
