"""Reference answers: for each registered query the same result in DuckDB SQL.

Written apart from the Spark code: plain `CASE` ladders over a vowel/consonant string
where the Spark side uses patterns, and views spelled out again.
"""

from __future__ import annotations

import hashlib

from lexitally.functions.stopwords import english_stop_words

# --- input views -------------------------------------------------------------------

DESCRIPTIONS = "descriptions AS (SELECT 'P' || doc_id AS product_id, text FROM documents)"

REQUESTS = """requests AS (
  SELECT event_id AS request_id, ts,
    CASE event_type
      WHEN 'error' THEN CASE WHEN event_id % 2 = 0
           THEN 'http%3A%2F%2Fwww.example.com%2Fgp%2Fproduct%2FP' || (event_id % 1200)
           ELSE 'http%3A%2F%2Fwww.amazon.com%2Fgp%2Fproduct%2F' END
      WHEN 'signup' THEN 'http%3A%2F%2Fwww.amazon.co.uk%2Fgp%2Fproduct%2FP' || (event_id % 1200)
      WHEN 'view' THEN 'http%3A%2F%2Fwww.amazon.de%2Fgp%2Fproduct%2FP' || (event_id % 1200)
      ELSE 'http%3A%2F%2Fwww.amazon.com%2Fgp%2Fproduct%2FP' || (event_id % 1200) END AS url
  FROM events)"""

# --- words -------------------------------------------------------------------------


def _clean(text: str) -> str:
    return (
        f"lower(regexp_replace(regexp_replace(regexp_replace({text}, '<[^>]*>', '', 'g'),"
        " '[-+:;,.]', ' ', 'g'), '[^a-zA-Z ]', '', 'g'))"
    )


# SHA-256 of the stop list, one word to a line.
STOP_LIST_HASH = "b4546516dc2c5435dd01cc101eb6b577b912363e26b3bc1d63b73da498bc392a"


def _stops() -> str:
    words = english_stop_words()
    if hashlib.sha256("\n".join(words).encode()).hexdigest() != STOP_LIST_HASH:
        raise ValueError("the stop list is not the one that the answers are made for")
    return ", ".join(f"'{w}'" for w in words)


def _tokens(source: str, keys: str, text: str = "text") -> str:
    """CTE `tokens`: one row per kept word of each row of `source`."""
    sep = ", " if keys else ""
    return (
        f"tokens AS (SELECT {keys}{sep}word FROM (SELECT {keys}{sep}"
        f"unnest(regexp_split_to_array({_clean(text)}, '\\s+')) AS word FROM {source})"
        f" WHERE length(word) > 1 AND word NOT IN ({_stops()}))"
    )


def _sounds(w: str) -> str:
    return (
        f"list_reduce(string_split({w}, ''), lambda a, c: a || CASE"
        " WHEN c IN ('a','e','i','o','u') THEN 'V'"
        " WHEN c = 'y' AND a <> '' AND right(a, 1) = 'C' THEN 'V'"
        " ELSE 'C' END, '')"
    )


def _turns(cv: str) -> str:
    return f"((length({cv}) - length(replace({cv}, 'VC', ''))) // 2)"


def _head(n: int, col: str) -> str:
    return f"left({col}, length({col}) - {n})"


def _cvc(w: str, cv: str) -> str:
    return f"(right({cv}, 3) = 'CVC' AND right({w}, 1) NOT IN ('w', 'x', 'y'))"


def _double(w: str, cv: str) -> str:
    return f"(length({w}) > 1 AND right({w}, 1) = left(right({w}, 2), 1) AND right({cv}, 1) = 'C')"


def _ladder(rules: list[tuple[str, str, str]]) -> str:
    """CASE over (suffix, condition on the rest, result); a failed condition ends it."""
    whens = " ".join(
        f"WHEN suffix(w, '{sfx}') THEN CASE WHEN {cond} THEN {out} ELSE w END"
        for sfx, cond, out in rules
    )
    return f"CASE {whens} ELSE w END"


# Suffixes of the stemmer's steps and what takes their place.
_STEP3 = {
    "ational": "ate",
    "tional": "tion",
    "enci": "ence",
    "anci": "ance",
    "izer": "ize",
    "bli": "ble",
    "alli": "al",
    "entli": "ent",
    "eli": "e",
    "ousli": "ous",
    "ization": "ize",
    "ation": "ate",
    "ator": "ate",
    "alism": "al",
    "iveness": "ive",
    "fulness": "ful",
    "ousness": "ous",
    "aliti": "al",
    "iviti": "ive",
    "biliti": "ble",
    "logi": "log",
}
_STEP4 = {
    "icate": "ic",
    "ative": "",
    "alize": "al",
    "iciti": "ic",
    "ical": "ic",
    "ful": "",
    "ness": "",
}
_STEP5 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion",
    "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


def _swaps(table: dict[str, str]) -> str:
    rules = []
    for sfx, out in table.items():
        n = len(sfx)
        rules.append((sfx, f"{_turns(_head(n, 'cv'))} > 0", f"{_head(n, 'w')} || '{out}'"))
    return _ladder(rules)


def _step5() -> str:
    rules = []
    for sfx in _STEP5:
        n = len(sfx)
        cond = f"{_turns(_head(n, 'cv'))} > 1"
        if sfx == "ion":
            cond += f" AND right({_head(3, 'w')}, 1) IN ('s', 't')"
        rules.append((sfx, cond, _head(n, "w")))
    return _ladder(rules)


def _stem_ctes(vocabulary: str) -> str:
    """CTEs `s0`..`s7` from `vocabulary(word)`; `stems(word, stem)` and each step's form."""
    def step(n: int, expr: str) -> str:
        keep = ", ".join(f"s{i}_form" for i in range(1, n))
        return (
            f"s{n} AS (SELECT word, {keep + ', ' if keep else ''}w AS s{n}_form, w, {_sounds('w')} AS cv"
            f" FROM (SELECT word, {keep + ', ' if keep else ''}{expr} AS w FROM s{n - 1}))"
        )

    plural = (
        f"CASE WHEN suffix(w, 'sses') OR suffix(w, 'ies') THEN {_head(2, 'w')}"
        f" WHEN suffix(w, 's') AND NOT suffix(w, 'ss') THEN {_head(1, 'w')} ELSE w END"
    )
    cut = (
        f"CASE WHEN suffix(w, 'eed') THEN CASE WHEN {_turns(_head(3, 'cv'))} > 0"
        f" THEN {_head(1, 'w')} ELSE w END"
        f" WHEN suffix(w, 'ed') AND contains({_head(2, 'cv')}, 'V') THEN {_head(2, 'w')} || '#'"
        f" WHEN suffix(w, 'ing') AND contains({_head(3, 'cv')}, 'V') THEN {_head(3, 'w')} || '#'"
        " ELSE w END"
    )
    b, bcv = "rtrim(w, '#')", _sounds("rtrim(w, '#')")
    tidy = (
        f"CASE WHEN NOT suffix(w, '#') THEN w"
        f" WHEN suffix({b}, 'at') OR suffix({b}, 'bl') OR suffix({b}, 'iz') THEN {b} || 'e'"
        f" WHEN {_double(b, bcv)} THEN CASE WHEN right({b}, 1) IN ('l', 's', 'z') THEN {b}"
        f" ELSE {_head(1, b)} END"
        f" WHEN {_turns(bcv)} = 1 AND {_cvc(b, bcv)} THEN {b} || 'e' ELSE {b} END"
    )
    final_y = (
        f"CASE WHEN suffix(w, 'y') AND contains({_head(1, 'cv')}, 'V')"
        f" THEN {_head(1, 'w')} || 'i' ELSE w END"
    )
    final_e = (
        f"CASE WHEN suffix(w, 'e') AND ({_turns('cv')} > 1 OR ({_turns('cv')} = 1 AND NOT"
        f" {_cvc(_head(1, 'w'), _head(1, 'cv'))})) THEN {_head(1, 'w')} ELSE w END"
    )
    final_l = (
        f"CASE WHEN suffix(w, 'll') AND {_turns('cv')} > 1 THEN {_head(1, 'w')} ELSE w END"
    )
    return ",\n".join(
        [
            f"s0 AS (SELECT word, word AS w, {_sounds('word')} AS cv FROM {vocabulary}"
            " WHERE length(word) > 2)",
            step(1, plural),
            f"cut AS (SELECT word, s1_form, {cut} AS w FROM s1)",
            f"s2 AS (SELECT word, s1_form, w AS s2_form, w, {_sounds('w')} AS cv"
            f" FROM (SELECT word, s1_form, {tidy} AS w FROM cut))",
            step(3, final_y),
            step(4, _swaps(_STEP3)),
            step(5, _swaps(_STEP4)),
            step(6, _step5()),
            step(7, final_e),
            step(8, final_l),
            "stems AS (SELECT word, w AS stem FROM s8 UNION ALL"
            f" SELECT word, word FROM {vocabulary} WHERE length(word) <= 2)",
        ]
    )


def vocabulary_stems(ctes: str, select: str) -> str:
    """`ctes` must define `tokens`; adds `vocabulary` and `stems`."""
    return (
        f"WITH {ctes},\nvocabulary AS (SELECT DISTINCT word FROM tokens),\n"
        f"{_stem_ctes('vocabulary')}\n{select}"
    )

# --- requests ----------------------------------------------------------------------

# The parts of the decoded URL; the product key follows the first part with the marker,
# and is the first part where no part has it.
LOCATED = """parted AS (
  SELECT request_id, ts, url,
    string_split(rtrim(url_decode(replace(url, '+', ' ')), '/'), '/') AS parts FROM requests),
placed AS (
  SELECT request_id, ts, url,
    list_filter(parts, lambda p: contains(p, 'amazon'))[1] AS found_host,
    parts[coalesce(list_position(list_transform(parts, lambda p: contains(p, 'product')), true), 0)
      + 1] AS found_id FROM parted),
located AS (
  SELECT request_id, ts, url,
    CASE WHEN found_host IS NOT NULL THEN found_id END AS product_id,
    CASE WHEN found_id IS NOT NULL THEN found_host END AS host FROM placed)"""

ACCEPTED = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY ts, request_id) AS place
  FROM located WHERE product_id IS NOT NULL),
accepted AS (
  SELECT r.product_id, r.ts, r.request_id, d.text
  FROM ranked r JOIN descriptions d ON d.product_id = r.product_id WHERE place = 1)"""

INPUTS = f"{REQUESTS},\n{DESCRIPTIONS},\n{LOCATED},\n{ACCEPTED}"

OUTCOMES = """outcomes AS (
  SELECT l.request_id, l.ts, l.product_id, l.host,
    CAST(CASE WHEN l.product_id IS NULL THEN 400 WHEN d.product_id IS NULL THEN 404
         WHEN r.place = 1 THEN 201 ELSE 200 END AS BIGINT) AS status,
    CASE WHEN l.product_id IS NULL THEN 'Product URL ' || l.url || ' is invalid'
         WHEN d.product_id IS NULL
           THEN 'Product ' || l.product_id || ' description is missing on ' || l.host
         WHEN r.place = 1 THEN 'Description of product ' || l.product_id
           || ' has been successfully processed'
         ELSE 'Product ' || l.product_id || ' description digest is already present, '
           || 'no fetching/processing required' END AS message
  FROM located l
  LEFT JOIN ranked r ON r.request_id = l.request_id
  LEFT JOIN descriptions d ON d.product_id = l.product_id)"""

# --- pages -------------------------------------------------------------------------

PARAGRAPH = "'(?s)<article>.*?<p[^>]*>(.*?)(?:</p>|<p[ >]|</article>)'"


def _paragraph() -> str:
    text = f"regexp_extract(html, {PARAGRAPH}, 1)"
    text = f"regexp_replace({text}, '<br[^>]*>', ' ', 'g')"
    text = f"regexp_replace({text}, '<[^>]*>', '', 'g')"
    for entity, char in (
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"),
        ("&amp;", "&"),
    ):
        text = f"replace({text}, '{entity}', '{char}')"
    text = f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN regexp_matches(html, {PARAGRAPH}) THEN {text} END"


PAGE_PARTS = (
    "string_split(rtrim(url_decode(replace(url, '+', ' ')), '/'), '/')"
)

XML_TEXT = "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE text END"

# --- counts ------------------------------------------------------------------------


def _counts(ctes: str, source: str, select: str, keys: str = "") -> str:
    """`counts(keys.., word, n)` over the stems of the texts of `source`."""
    sep = f"{keys}, " if keys else ""
    tokens = _tokens(source, keys)
    prefix = f"{ctes},\n" if ctes else ""
    return vocabulary_stems(
        f"{prefix}{tokens}",
        f", counts AS (SELECT {sep}s.stem AS word, count(*) AS n FROM tokens t"
        f" JOIN stems s ON s.word = t.word GROUP BY {sep}s.stem)\n{select}",
    )


RANKED = "row_number() OVER (ORDER BY n DESC, word DESC)"


def _top(ctes: str, source: str, k: int) -> str:
    select = (
        f"SELECT {RANKED} AS rank, word, n FROM counts QUALIFY rank <= {k}"
    )
    return _counts(ctes, source, select)


BY_DAY = (
    f"{INPUTS},\nby_day AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS day, text FROM accepted)"
)
BY_PART = (
    f"{INPUTS},\nby_part AS (SELECT CAST(CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 0"
    " WHEN ts < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END AS BIGINT) AS batch_id, text"
    " FROM accepted)"
)
EVENT_DAYS = (
    "event_days AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type AS word,"
    " count(*) AS n FROM events GROUP BY 1, 2)"
)


def _running(source: str, day: str = "day") -> str:
    return (
        f"SELECT {day}, word, n, CAST(sum(n) OVER (PARTITION BY word ORDER BY {day}"
        f" ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM {source}"
    )


def _top_per_day(source: str, k: int) -> str:
    """For every day the totals of all words so far, ranked."""
    return (
        f"SELECT date_diff('day', DATE '1970-01-01', d.day) AS batch_no,"
        " row_number() OVER (PARTITION BY d.day ORDER BY sum(c.n) DESC, c.word DESC) AS rank,"
        " c.word, CAST(sum(c.n) AS BIGINT) AS total"
        f" FROM (SELECT DISTINCT day FROM {source}) d JOIN {source} c ON c.day <= d.day"
        f" GROUP BY d.day, c.word QUALIFY rank <= {k}"
    )


# --- bit addresses -----------------------------------------------------------------

ADDRESSES = """digests AS (
  SELECT key, md5(from_hex('d4d1c83dd63a46cf8597d6e8d2a0b0ba') || encode(key)) AS h FROM keys),
halves AS (
  SELECT key,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS high,
    CAST('0x' || substr(h, 9, 4) || '3' || substr(h, 14, 3) AS BIGINT) AS low,
    CAST('0x' || substr(h, 30, 3) AS BIGINT) % 1024 AS tail FROM digests),
addresses AS (
  SELECT key, (1024 - tail) % 1024 AS bucket,
    CASE WHEN xor(high, low) >= 2147483648 THEN 4294967296 - xor(high, low)
         ELSE xor(high, low) END AS "offset" FROM halves)"""
PART_KEYS = "keys AS (SELECT 'P' || p_partkey AS key FROM part)"


def oracle_sql() -> dict[str, str]:
    words = _tokens("documents", "doc_id")
    clean = _clean("text")
    documents_counts = _counts("", "documents", "SELECT word, n FROM counts")
    accepted_counts = _counts(INPUTS, "accepted", "SELECT word, n FROM counts")
    letters = "regexp_replace(regexp_replace(text, '[-+:;,.]', ' ', 'g'), '[^a-zA-Z ]', '', 'g')"
    described_seen = f"WITH {REQUESTS},\n{DESCRIPTIONS},\n{LOCATED}"
    first_batch = (
        "CAST(CASE WHEN min(ts) < TIMESTAMP '2024-01-11' THEN 0"
        " WHEN min(ts) < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END AS BIGINT)"
    )
    batch = (
        "CAST(CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 0"
        " WHEN ts < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END AS BIGINT)"
    )
    answers = (
        f"WITH {REQUESTS},\n{LOCATED}, parts AS (SELECT *, {batch} AS batch_id FROM located),"
        " answers AS (SELECT *, product_id IS NOT NULL"
        " AND min(batch_id) OVER (PARTITION BY product_id) < batch_id AS stored,"
        " product_id IS NOT NULL"
        " AND row_number() OVER (PARTITION BY product_id ORDER BY ts, request_id) = 1 AS first"
        " FROM parts)"
    )
    keys_in_parts = (
        f"WITH {REQUESTS},\n{LOCATED}, parts AS (SELECT *, {batch} AS batch_id FROM located),"
        " keys AS (SELECT DISTINCT product_id AS key FROM parts WHERE product_id IS NOT NULL)"
    )
    steps = {
        "drop_plural": 1, "drop_past_and_gerund": 2, "final_y_to_i": 3,
        "swap_double_suffixes": 4, "swap_single_suffixes": 5, "drop_last_suffix": 6,
        "drop_final_e_and_l": 8,
    }
    step_columns = ", ".join(
        f"{'w' if n == 8 else f's{n}_form'} AS {name}" for name, n in steps.items()
    )
    short_columns = ", ".join(f"word AS {name}" for name in steps)
    outcome_select = "SELECT request_id, ts, product_id, host, status, message FROM outcomes"
    in_order = (
        "string_agg(word, ' ' ORDER BY place)"
    )
    return {
        "scan_requests": f"WITH {REQUESTS} SELECT request_id, ts, url FROM requests",
        "stream_source": f"WITH {DESCRIPTIONS} SELECT product_id, text FROM descriptions",
        "html_first_text": f"SELECT page_id, {_paragraph()} AS text FROM pages",
        "html_by_id": (
            "SELECT page_id, CASE WHEN page_id % 3 <> 0 AND contains(html, '<article>')"
            " THEN 'café — it’s A' END AS text FROM pages"
        ),
        "xml_editorial_review": f"SELECT doc_id, {XML_TEXT} AS text FROM documents",
        "publish_descriptions": (
            f"WITH {INPUTS} SELECT a.product_id, a.text, CAST(CASE"
            " WHEN ts < TIMESTAMP '2024-01-11' THEN 0 WHEN ts < TIMESTAMP '2024-01-21' THEN 1"
            " ELSE 2 END AS BIGINT) AS batch_id FROM accepted a"
        ),
        "insert_seen": (
            f"WITH {REQUESTS},\n{LOCATED} SELECT product_id, {first_batch} AS batch_id"
            " FROM located WHERE product_id IS NOT NULL GROUP BY product_id"
        ),
        "scan_seen": (
            f"WITH {REQUESTS},\n{LOCATED} SELECT DISTINCT product_id FROM located"
            " WHERE product_id IS NOT NULL"
        ),
        "stream_insert": f"{answers} SELECT request_id, product_id, batch_id, stored, first FROM answers",
        "stream_duplicate_flag": (
            f"{answers} SELECT batch_id, count(*) AS rows, count(*) FILTER (first) AS new_keys,"
            " bool_or(stored) AS duplicate, bool_or(NOT first) AS duplicate_strict FROM answers"
            " WHERE product_id IS NOT NULL GROUP BY batch_id"
        ),
        "upsert_counts": accepted_counts,
        "scan_counts": accepted_counts,
        "json_answer": _counts(
            "",
            "documents",
            f", top AS (SELECT word, n FROM counts QUALIFY {RANKED} <= 25)"
            " SELECT '{\"topK\":25,\"wordCounts\":[' ||"
            " string_agg('[\"' || word || '\",' || n || ']', ',' ORDER BY n DESC, word DESC)"
            " || ']}' AS answer FROM top",
        ),
        "decode_url": (
            f"WITH {REQUESTS} SELECT request_id, url_decode(replace(url, '+', ' ')) AS decoded"
            " FROM requests"
        ),
        "split_path": (
            f"SELECT page_id, len({PAGE_PARTS}) AS n, array_to_string({PAGE_PARTS}, '|') AS parts"
            " FROM pages"
        ),
        "extract_host": (
            f"SELECT page_id, list_filter({PAGE_PARTS}, lambda p: contains(p, 'example.'))[1]"
            " AS host FROM pages"
        ),
        "extract_product_id": "SELECT page_id, " + ", ".join(
            f"{PAGE_PARTS}[coalesce(list_position(list_transform({PAGE_PARTS},"
            f" lambda p: contains(p, '{marker}')), true), 0) + 1] AS {name}"
            for marker, name in (("example.", "product_id"), ("blog", "product_id_blog"))
        ) + " FROM pages",
        "product_locator": (
            f"WITH {REQUESTS},\n{LOCATED} SELECT request_id, product_id, host FROM located"
        ),
        "marketplace": (
            f"WITH {REQUESTS},\n{LOCATED} SELECT request_id,"
            " CASE WHEN host IS NULL THEN NULL WHEN suffix(host, '.uk') THEN 'uk'"
            " WHEN suffix(host, '.de') THEN 'de' ELSE 'com' END AS marketplace,"
            " CASE WHEN host IS NOT NULL THEN 'com' END AS marketplace_unsplit FROM located"
        ),
        "strip_tags": (
            "SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS text FROM pages"
        ),
        "punct_to_space": (
            "SELECT doc_id, regexp_replace(text, '[-+:;,.]', ' ', 'g') AS text FROM documents"
        ),
        "keep_letters": (
            "SELECT doc_id, regexp_replace(text, '[^a-zA-Z ]', '', 'g') AS text FROM documents"
        ),
        "lower_text": f"SELECT doc_id, {clean} AS text FROM documents",
        "split_words": (
            f"SELECT doc_id, len(regexp_split_to_array(rtrim(lower({letters})), '\\s+')) AS n,"
            f" array_to_string(regexp_split_to_array(rtrim(lower({letters})), '\\s+'), '|')"
            " AS words FROM documents"
        ),
        "min_length": (
            f"SELECT page_id, array_to_string(list_filter(regexp_split_to_array({_clean('html')},"
            " '\\s+'), lambda w: length(w) > 1), ' ') AS words FROM pages"
        ),
        "remove_stopwords": (
            f"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array({clean}, '\\s+'),"
            f" lambda w: length(w) > 1 AND w NOT IN ({_stops()})), ' ') AS words FROM documents"
        ),
        "remove_listed_words": (
            f"WITH listed AS (SELECT DISTINCT unnest(regexp_split_to_array({clean}, '\\s+')) AS w"
            " FROM benchmark), found AS (SELECT doc_id,"
            f" unnest(regexp_split_to_array({clean}, '\\s+')) AS w FROM documents)"
            " SELECT doc_id, count(*) AS n FROM found WHERE length(w) > 1"
            " AND w NOT IN (SELECT w FROM listed) GROUP BY doc_id"
        ),
        "stem_vocabulary": vocabulary_stems(words, "SELECT word, stem FROM stems"),
        "stem_steps": vocabulary_stems(
            words,
            f"SELECT word, {step_columns} FROM s8 UNION ALL SELECT word, {short_columns}"
            " FROM vocabulary WHERE length(word) <= 2",
        ),
        "stem_predicates": (
            f"WITH {words}, v AS (SELECT word, {_sounds('word')} AS cv FROM"
            " (SELECT DISTINCT word FROM tokens))"
            f" SELECT word, cv AS sounds, {_turns('cv')} AS turns, contains(cv, 'V') AS has_vowel,"
            f" {_double('word', 'cv')} AS double_consonant, {_cvc('word', 'cv')} AS short_end,"
            " suffix(word, 'ing') AS ends_ing FROM v"
        ),
        "tokenize": vocabulary_stems(
            f"listed AS (SELECT doc_id, regexp_split_to_array({clean}, '\\s+') AS ws FROM documents),"
            " placed AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS place"
            " FROM listed), tokens AS (SELECT doc_id, word, place FROM placed"
            f" WHERE length(word) > 1 AND word NOT IN ({_stops()}))",
            ", stemmed AS (SELECT t.doc_id, s.stem AS word, t.place FROM tokens t"
            " JOIN stems s ON s.word = t.word)"
            f" SELECT d.doc_id, count(s.word) AS n, coalesce({in_order}, '') AS tokens"
            " FROM documents d LEFT JOIN stemmed s ON s.doc_id = d.doc_id GROUP BY d.doc_id",
        ),
        "word_counts": documents_counts,
        "flat_tokens": vocabulary_stems(
            words,
            "SELECT t.doc_id, s.stem AS word FROM tokens t JOIN stems s ON s.word = t.word",
        ),
        "custom_tokenizer": (
            "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\\s+'))"
            " AS word FROM documents) GROUP BY word"
        ),
        "batch_word_counts": _counts(BY_DAY, "by_day", "SELECT day, word, n FROM counts", "day"),
        "merge_counts": documents_counts,
        "reduce_by_key": (
            "SELECT l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_quantity,"
            " max(l_extendedprice) AS max_price, min(l_extendedprice) AS min_price"
            " FROM lineitem GROUP BY l_partkey"
        ),
        "running_counts": f"WITH {EVENT_DAYS} {_running('event_days')}",
        "running_word_counts": _counts(BY_DAY, "by_day", _running("counts"), "day"),
        "counts_as_of": _counts(
            BY_DAY,
            "by_day",
            "SELECT word, CAST(sum(n) AS BIGINT) AS n FROM counts"
            " WHERE day <= DATE '2024-01-10' GROUP BY word",
            "day",
        ),
        "contains": (
            f"{described_seen} SELECT request_id, l.product_id,"
            " (l.product_id IS NOT NULL AND l.product_id IN (SELECT product_id FROM descriptions))"
            " AS contained FROM located l"
        ),
        "new_keys": (
            f"{described_seen} SELECT DISTINCT product_id FROM located WHERE product_id IS NOT NULL"
            " AND product_id NOT IN (SELECT product_id FROM descriptions)"
        ),
        "first_wins": (
            f"WITH {INPUTS} SELECT product_id, ts, request_id, url,"
            " (SELECT count(*) FROM located l WHERE l.product_id = r.product_id) AS n"
            " FROM ranked r WHERE place = 1"
        ),
        "duplicate_flag": (
            f"WITH {REQUESTS},\n{LOCATED}, days AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS day,"
            " product_id FROM located WHERE product_id IS NOT NULL),"
            " firsts AS (SELECT product_id, min(day) AS first_day FROM days GROUP BY product_id)"
            " SELECT day, count(*) AS rows, count(DISTINCT d.product_id) AS keys,"
            " count(DISTINCT CASE WHEN first_day = day THEN d.product_id END) AS new_keys,"
            " bool_or(first_day < day) AS duplicate,"
            " bool_or(first_day < day) OR count(*) > count(DISTINCT d.product_id)"
            " AS duplicate_strict"
            " FROM days d JOIN firsts f ON f.product_id = d.product_id GROUP BY day"
        ),
        "put_overwrite": (
            "SELECT user_id, value FROM events QUALIFY row_number() OVER"
            " (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"
        ),
        "batch_remove": (
            "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN"
            " (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"
        ),
        "key_locator": f'WITH {PART_KEYS}, {ADDRESSES} SELECT key, bucket, "offset" FROM addresses',
        "seen_bits": (
            f'WITH {PART_KEYS}, {ADDRESSES} SELECT DISTINCT bucket, "offset" FROM addresses'
        ),
        "seen_bitmaps": (
            f'WITH {PART_KEYS}, {ADDRESSES} SELECT bucket, count(DISTINCT "offset") AS bits,'
            ' count(DISTINCT "offset" // 32768) AS pages FROM addresses GROUP BY bucket'
        ),
        "approx_contains": (
            f"{described_seen}, keys AS (SELECT DISTINCT product_id AS key FROM located"
            " WHERE product_id IS NOT NULL UNION SELECT product_id FROM descriptions),"
            f' {ADDRESSES}, bits AS (SELECT DISTINCT a.bucket, a."offset" FROM addresses a'
            " JOIN descriptions d ON d.product_id = a.key)"
            " SELECT l.request_id, l.product_id, b.bucket IS NOT NULL AS contained FROM located l"
            " LEFT JOIN addresses a ON a.key = l.product_id"
            ' LEFT JOIN bits b ON b.bucket = a.bucket AND b."offset" = a."offset"'
        ),
        "set_and_report": (
            f"{keys_in_parts}, {ADDRESSES},"
            ' set_by AS (SELECT a.bucket, a."offset", min(p.batch_id) AS first FROM parts p'
            ' JOIN addresses a ON a.key = p.product_id GROUP BY a.bucket, a."offset")'
            " SELECT p.request_id, p.product_id, p.batch_id,"
            " coalesce(s.first < p.batch_id, false) AS was_set FROM parts p"
            " LEFT JOIN addresses a ON a.key = p.product_id"
            ' LEFT JOIN set_by s ON s.bucket = a.bucket AND s."offset" = a."offset"'
        ),
        "merged_bitmaps": (
            f'{keys_in_parts}, {ADDRESSES} SELECT bucket, count(DISTINCT "offset") AS bits,'
            ' count(DISTINCT "offset" // 32768) AS pages FROM addresses GROUP BY bucket'
        ),
        "ranked_words": documents_counts,
        "top_k": _counts(
            "", "documents", f"SELECT word, n FROM counts QUALIFY {RANKED} <= 10"
        ),
        "cutoff": _counts(
            "", "documents", f"SELECT word, n FROM counts QUALIFY {RANKED} <= 1001"
        ),
        "rank_column": _top("", "documents", 25),
        "top_k_per_batch": f"WITH {EVENT_DAYS} {_top_per_day('event_days', 3)}",
        "top_words_per_second": (
            "WITH seconds AS (SELECT epoch_ms(date_trunc('second', ts)) AS day, event_type AS word,"
            " count(*) AS n FROM events GROUP BY 1, 2) SELECT d.day AS batch_no,"
            " row_number() OVER (PARTITION BY d.day ORDER BY sum(c.n) DESC, c.word DESC) AS rank,"
            " c.word, CAST(sum(c.n) AS BIGINT) AS total FROM (SELECT DISTINCT day FROM seconds) d"
            " JOIN seconds c ON c.day <= d.day GROUP BY d.day, c.word QUALIFY rank <= 3"
        ),
        "top_words_per_batch": _counts(BY_DAY, "by_day", _top_per_day("counts", 10), "day"),
        "fetch_join": (
            f"{described_seen} SELECT request_id, l.product_id, d.text FROM located l"
            " LEFT JOIN descriptions d ON d.product_id = l.product_id"
            " WHERE l.product_id IS NOT NULL"
        ),
        "missing_requests": (
            f"{described_seen} SELECT request_id, product_id, host FROM located"
            " WHERE product_id IS NOT NULL"
            " AND product_id NOT IN (SELECT product_id FROM descriptions)"
        ),
        "missing_report": (
            f"{described_seen} SELECT product_id, count(*) AS requests, max(ts) AS last_ts"
            " FROM located WHERE product_id IS NOT NULL"
            " AND product_id NOT IN (SELECT product_id FROM descriptions) GROUP BY product_id"
        ),
        "request_outcome": f"WITH {INPUTS},\n{OUTCOMES} {outcome_select}",
        "outcome_summary": (
            f"WITH {INPUTS},\n{OUTCOMES} SELECT status, count(*) AS requests,"
            " count(DISTINCT product_id) AS products FROM outcomes GROUP BY status"
        ),
        "accepted_descriptions": (
            f"WITH {INPUTS} SELECT product_id, ts, request_id, text FROM accepted"
        ),
        "end_to_end": _top(INPUTS, "accepted", 25),
        "end_to_end_xml": _top(
            INPUTS.replace(
                DESCRIPTIONS,
                "descriptions AS (SELECT 'P' || doc_id AS product_id, text FROM documents"
                " WHERE doc_id % 5 <> 0)",
            ),
            "accepted",
            25,
        ),
        "end_to_end_html": _top(
            INPUTS.replace(
                DESCRIPTIONS,
                f"descriptions AS (SELECT 'P' || page_id AS product_id, {_paragraph()} AS text"
                " FROM pages)",
            ),
            "accepted",
            25,
        ),
        "micro_batch": _counts(
            BY_PART, "by_part", "SELECT batch_id, word, n FROM counts", "batch_id"
        ),
        "stream_word_count": documents_counts,
        "stream_processor": (
            "SELECT lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents"
            " GROUP BY lang"
        ),
        "stream_first_wins": f"WITH {INPUTS} SELECT product_id FROM accepted",
        "checkpoint_restart": accepted_counts,
        "serve_snapshot": _counts(
            f"{BY_PART},\ntwo_parts AS (SELECT text FROM by_part WHERE batch_id <= 1)",
            "two_parts",
            "SELECT word, n FROM counts",
        ),
        "stream_request_outcome": (
            f"WITH {INPUTS},\n{OUTCOMES} SELECT request_id, product_id, host, status, message,"
            " CAST(CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 0"
            " WHEN ts < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END AS BIGINT) AS batch_id"
            " FROM outcomes"
        ),
        "stream_end_to_end": _top(INPUTS, "accepted", 25),
        "rate_limit": (
            "SELECT count(*) AS requests, CAST(1 AS BIGINT) AS files_per_batch FROM events"
        ),
    }
