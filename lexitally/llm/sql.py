"""DuckDB SQL for the queries of the operators."""

from __future__ import annotations

from lexitally.llm import mixing as mix
from lexitally.llm import quality_rules as rules


def quoted(words: list[str] | tuple[str, ...]) -> str:
    return ", ".join("'" + word.replace("'", "''") + "'" for word in words)


def counted(documents: str, id_col: str = "doc_id") -> str:
    """A chain of common tables that ends in ``counted``: one row per document."""
    word = r"[^\x20\x09-\x0D]+"
    return rf"""
    texts AS MATERIALIZED (
      SELECT {id_col} AS doc_id, coalesce(text, '') AS text FROM {documents}),
    worded AS MATERIALIZED (
      SELECT doc_id, text, regexp_extract_all(text, '{word}') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines
      FROM texts),
    spots AS (
      SELECT doc_id, unnest(generate_series(1, len(words) - {rules.WINDOW - 1})) AS i, words
      FROM worded WHERE len(words) >= {rules.WINDOW}),
    windows AS (
      SELECT doc_id, i, list_slice(words, i, i + {rules.WINDOW - 1}) AS w FROM spots),
    repeated AS (
      SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
    covered AS (
      SELECT doc_id, count(DISTINCT j) AS n FROM (
        SELECT doc_id, unnest(generate_series(i, i + {rules.WINDOW - 1})) AS j FROM repeated)
      GROUP BY doc_id),
    counted AS MATERIALIZED (
      SELECT doc_id, len(words) AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        len(list_filter(
          regexp_extract_all(lower(regexp_replace(text, '[.,;:!?()"¿¡]', '', 'g')), '{word}'),
          lambda x: x IN ({quoted(rules.STOP_WORDS)}))) AS n_stop_words,
        len(lines) AS n_lines,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(n, 0) AS n_repeat_words,
        length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS n_upper,
        length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS n_letters
      FROM worded LEFT JOIN covered USING (doc_id))"""


def _passes(rule: rules.Rule) -> str:
    value = f"{rule.part}::DOUBLE / {rule.whole}"
    bounds = [f"{value} >= {rule.low}"] if rule.low is not None else []
    bounds += [f"{value} <= {rule.high}"] if rule.high is not None else []
    return f"({rule.whole} = 0 OR n_words < {rule.from_words} OR ({' AND '.join(bounds)}))"


FAILED = "(n_words < 10 OR 100 * n_repeat_words > 20 * n_words)"


def kept() -> str:
    return f"(NOT {FAILED} AND {' AND '.join(_passes(r) for r in rules.RULES)})"


def quality_rules() -> str:
    counts = ", ".join(f"{name}::BIGINT AS {name}" for name in rules.COUNTS)
    return f"""WITH {counted('documents')}
    SELECT doc_id, {counts}, {FAILED} AS base_failed, {kept()} AS kept FROM counted"""


EXACT_DEDUP = """SELECT doc_id, max(doc_id) OVER same AS keep_id,
      count(*) OVER same AS group_size,
      doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""


# Rounds of raking, enough for the tables at hand: the weights no longer change by then.
MIX_ROUNDS = 32


def mixed(documents: str, powers: dict[str, float], share: float, seed: str = "mix") -> str:
    """A chain of common tables that ends in ``drawn``: one row per document."""
    classes = " ".join(f"WHEN strlen(text) < {below} THEN '{name}'" for name, below in mix.CLASSES)
    names = ", ".join(powers)
    chain = f"""
    filled AS (
      SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source,
        coalesce(lang, '') AS lang FROM {documents}),
    classed AS MATERIALIZED (
      SELECT doc_id, source, lang, CASE {classes} ELSE 'book' END AS topic,
        1 + strlen(text) // {mix.BYTES_PER_TOKEN} AS tokens,
        ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT
          / {1 << 52}::DOUBLE AS draw
      FROM filled),
    cells0 AS MATERIALIZED (
      SELECT {names}, sum(tokens)::DOUBLE AS tokens, {share}::DOUBLE AS w
      FROM classed GROUP BY {names})"""
    for name, power in powers.items():
        # Values by how soon they are full; the first that is not sets the level for all.
        chain += f""",
    sums_{name} AS MATERIALIZED (
      SELECT {name}, sum(tokens) AS have, pow(sum(tokens), {power}) AS weight
      FROM cells0 GROUP BY {name}),
    levels_{name} AS MATERIALIZED (
      SELECT *, ({share} * sum(have) OVER () - coalesce(sum(have) OVER before, 0))
        / sum(weight) OVER rest AS level FROM sums_{name}
      WINDOW before AS (ORDER BY have / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        rest AS (ORDER BY have / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    want_{name} AS MATERIALIZED (
      SELECT {name}, least(have, weight * (SELECT arg_min(level, have / weight)
        FILTER (level * weight <= have) FROM levels_{name})) AS want FROM sums_{name})"""
    step = 0
    for _ in range(MIX_ROUNDS):
        for name in powers:
            chain += f""",
    cells{step + 1} AS MATERIALIZED (
      SELECT c.* REPLACE (w * CASE WHEN want > filled AND rest > 0 THEN (want - filled) / rest
        ELSE want / have END AS w) FROM cells{step} c
      JOIN (SELECT {name}, sum(tokens * least(1.0, w)) AS have,
          sum(CASE WHEN w >= 1 THEN tokens ELSE 0 END) AS filled,
          sum(CASE WHEN w >= 1 THEN 0 ELSE tokens * w END) AS rest
        FROM cells{step} GROUP BY {name})
        USING ({name}) JOIN want_{name} USING ({name}))"""
            step += 1
    return chain + f""",
    drawn AS MATERIALIZED (
      SELECT d.doc_id, {names}, d.tokens, round(p, 4) AS probability, draw < p AS kept
      FROM classed d JOIN (SELECT {names}, least(1.0, w) AS p FROM cells{step}) USING ({names}))"""


def mixing(powers: dict[str, float], share: float) -> str:
    return f"""WITH {mixed("documents", powers, share)}
    SELECT doc_id, source, lang, topic, tokens::BIGINT AS tokens, probability, kept FROM drawn"""
