"""SQL of the views and of the scoring expressions, for the comparison engine."""

from __future__ import annotations

from itertools import count

_fresh = count()


def name() -> str:
    return f"v{next(_fresh)}"


def quote(text: str) -> str:
    """SQL string literal; control characters written with chr()."""
    pieces, plain = [], ""
    for ch in text:
        if ord(ch) < 32:
            if plain:
                pieces.append("'" + plain.replace("'", "''") + "'")
                plain = ""
            pieces.append(f"chr({ord(ch)})")
        else:
            plain += ch
    if plain or not pieces:
        pieces.append("'" + plain.replace("'", "''") + "'")
    return "(" + " || ".join(pieces) + ")"


def symbols(x: str) -> str:
    return f"translate(replace(lower({x}), 'th', '->'), 'hgwkbv', '()[]∧¬')"


def depth(x: str) -> str:
    c, i, p, q, k = name(), name(), name(), name(), name()
    kinds = f"translate(regexp_replace({x}, '[^()\\[\\]{{}}]', '', 'g'), '[]{{}}', '()()')"
    opened = (
        f"list_filter(list_transform(string_split({kinds}, ''), "
        f"lambda {c}, {i}: CASE WHEN {c} = '(' THEN {i} END), lambda {p}: {p} IS NOT NULL)"
    )
    return (
        f"greatest(1, coalesce(list_max(list_transform({opened}, "
        f"lambda {q}, {k}: 2 * {k} - {q})), 1))"
    )


def operators(x: str) -> str:
    return f"length(regexp_replace(replace({x}, '->', '→'), '[^∧∨→¬~←]', '', 'g'))"


def avg_depth(xs: str) -> str:
    e, d = name(), name()
    return (
        f"list_transform([list_transform({xs}, lambda {e}: {depth(e)})], lambda {d}: "
        f"CASE WHEN len({d}) > 0 THEN list_sum({d})::DOUBLE / len({d}) ELSE 1.0::DOUBLE END)[1]"
    )


def squared(x: str) -> str:
    v = name()
    return f"list_transform([{x}], lambda {v}: {v} * {v})[1]"


def context_score(xs: str, predicates: str, constants: str) -> str:
    return f"(len({xs}) * {squared(avg_depth(xs))} + len({predicates}) + len({constants}))"


def preconditions_score(xs: str) -> str:
    return f"(len({xs}) * {squared(avg_depth(xs))})"


def step_score(x: str) -> str:
    return (
        f"CASE WHEN {x} IN ('N/A', 'Derivation cannot proceed') THEN 0.0::DOUBLE "
        f"ELSE {squared(depth(x) + '::DOUBLE')} * ({operators(x)} + 1) END"
    )


def _total(xs: str) -> str:
    return f"coalesce(list_sum({xs}), 0.0::DOUBLE)"


def deduction_score(expressions: str) -> str:
    s = name()
    return _total(f"list_transform({expressions}, lambda {s}: {step_score(s)})")


def step_expression(s: str) -> str:
    return (
        f"CASE WHEN length({s}) = 0 THEN 'N/A' WHEN length({s}) < 15 THEN 'Derivation cannot proceed' "
        f"WHEN length({s}) < 25 THEN 'Derivation cannot proceed.' ELSE {s} END"
    )


_line, _s = name(), name()
_o = name()

CTES = {
    "items": """items AS (
  SELECT doc_id AS id, source AS dataname,
    CASE lang WHEN 'en' THEN 'MCQA' WHEN 'es' THEN NULL WHEN 'de' THEN 'NLI' ELSE 'BQA' END AS task_type,
    upper(lang) AS reasoning_type, text AS context,
    'What follows from text ' || doc_id || '?' AS question,
    string_split(text, chr(10)) AS options,
    CASE WHEN lang = 'en' THEN (n_chars % 4)::VARCHAR
         WHEN n_chars % 2 = 0 THEN 'yes' ELSE 'no' END AS answer,
    CASE WHEN source IN ('src0', 'src1') THEN 'test' WHEN source = 'src2' THEN 'dev'
         ELSE 'train' END AS split
  FROM documents)""",
    "extracted": f"""extracted AS (
  SELECT *, string_split(context, ',') AS predicates, string_split(context, ' ') AS constants,
    string_split(sym, '.') AS logical_expressions
  FROM (SELECT *, {symbols('context')} AS sym FROM items))""",
    "analysed": f"""analysed AS (
  SELECT *, list_transform(string_split(sym, chr(10)), lambda {_line}: {{
      'preconditions': string_split({_line}, ','),
      'expressions': list_transform(string_split({_line}, '.'), lambda {_s}: {step_expression(_s)})
    }}) AS option_analysis
  FROM extracted)""",
    "raw": f"""raw AS (
  SELECT id, dataname,
    ln(greatest({context_score('logical_expressions', 'predicates', 'constants')}
       + {_total(f"list_transform(option_analysis, lambda {_o}: "
                 f"{preconditions_score(_o + '.preconditions')} + "
                 f"{deduction_score(_o + '.expressions')})")}, 0.0::DOUBLE) + 1) AS score_log
  FROM analysed)""",
    "scores": """scores AS (
  SELECT raw.id, raw.dataname, raw.score_log,
    1.0::DOUBLE / (1.0::DOUBLE + exp(-((score_log - m) / sqrt(v + 1e-5)))) AS score_norm
  FROM raw, (SELECT avg(score_log) AS m, var_pop(score_log) AS v FROM raw))""",
    "yes_no": """yes_no AS (
  SELECT doc_id, CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS label,
    CASE WHEN toxic = 1 AND quality = 0 THEN NULL WHEN toxic = 0 THEN 'yes' ELSE 'no' END AS predict
  FROM labels)""",
    "classes": """classes AS (
  SELECT vec_id, (label % 4)::VARCHAR AS label,
    ((label + CASE WHEN len(list_filter(embedding, lambda x: x > 0)) > len(embedding) / 2 THEN 1 ELSE 0 END) % 4)::VARCHAR AS predict
  FROM embeddings)""",
    "scored_predictions": """scored_predictions AS (
  SELECT y.*, s.score_log, s.score_norm FROM yes_no y JOIN scores s ON y.doc_id = s.id)""",
    "all_predictions": """all_predictions AS (
  SELECT 'labels' AS dataset, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS model,
    label, predict FROM yes_no
  UNION ALL
  SELECT 'embeddings', CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END, label, predict
  FROM classes)""",
}

NEEDS = {
    "items": [],
    "extracted": ["items"],
    "analysed": ["extracted"],
    "raw": ["analysed"],
    "scores": ["raw"],
    "yes_no": [],
    "classes": [],
    "scored_predictions": ["yes_no", "scores"],
    "all_predictions": ["yes_no", "classes"],
}


def sql(body: str, *views: str, extra: str = "", recursive: bool = False) -> str:
    """``body`` below the named views and what they need."""
    order: list[str] = []

    def add(view: str) -> None:
        for needed in NEEDS[view]:
            add(needed)
        if view not in order:
            order.append(view)

    for view in views:
        add(view)
    parts = [CTES[v] for v in order] + ([extra] if extra else [])
    if not parts:
        return body
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" + body
