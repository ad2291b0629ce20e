"""DuckDB counterparts of the readers in ``tables``, as fragments of WITH clauses."""


def fold(x: str) -> str:
    for a, b in (("æ", "ae"), ("œ", "oe"), ("ß", "ss")):
        x = f"replace({x}, '{a}', '{b}')" if a != "æ" else f"replace(lower({x}), '{a}', '{b}')"
    return f"trim(regexp_replace(strip_accents({x}), '\\s+', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def sentences(x: str) -> str:
    """Sentences of a line; RE2 has no look-behind, so the space behind an end mark becomes a newline first."""
    return f"regexp_split_to_array(regexp_replace({x}, '([.;·!?])\\s+', '\\1' || chr(10), 'g'), '\\n+')"


def roman(n: str) -> str:
    """Roman numeral of a positive number."""
    ones, tens = (["", *"I II III IV V VI VII VIII IX".split()], ["", *"X XX XXX XL L LX LXX LXXX XC".split()])
    hundreds = ["", *"C CC CCC CD D DC DCC DCCC CM".split()]
    at = lambda words, unit: f"{words}[(({n}) // {unit}) % 10 + 1]"
    return f"(repeat('M', (({n}) // 1000)::INT) || {at(hundreds, 100)} || {at(tens, 10)} || {at(ones, 1)})"


WORKS = "works AS (SELECT doc_id AS work_id, source AS author, lang, CASE WHEN source <> 'src0' THEN source END AS translator FROM documents)"
PASSAGES = """passages AS (SELECT * FROM (SELECT doc_id AS work_id, source AS author, lang, unnest(range(len(string_split(text, chr(10)))))::INT AS pos,
    unnest(string_split(text, chr(10))) AS text FROM documents) WHERE text <> '')"""
TOKENS = f"tokens AS (SELECT doc_id AS work_id, source AS author, lang, unnest({words(fold('text'))}) AS key FROM documents)"
SURFACES = f"""surfaces AS (SELECT work_id, lang, unnest(range(len(w)))::INT AS pos, unnest(w) AS surface
    FROM (SELECT doc_id AS work_id, lang, {words('text')} AS w FROM documents))"""
TREE = """tree AS (
    SELECT r_regionkey::BIGINT AS root, 'r' || r_regionkey AS id, NULL AS parent, 0 AS depth, [r_regionkey::BIGINT] AS path FROM region
    UNION ALL SELECT n_regionkey, 'n' || n_nationkey, 'r' || n_regionkey, 1, [n_regionkey, n_nationkey] FROM nation
    UNION ALL SELECT n_regionkey, 'c' || c_custkey, 'n' || n_nationkey, 2, [n_regionkey, n_nationkey, c_custkey] FROM nation JOIN customer ON c_nationkey = n_nationkey
    UNION ALL SELECT n_regionkey, 'o' || o_orderkey, 'c' || c_custkey, 3, [n_regionkey, n_nationkey, c_custkey, o_orderkey]
      FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey)"""
EVIDENCE = "ev AS (SELECT event_id, user_id, ts AS t, event_type AS type, value, json_extract_string(props, '$.k')::INT AS k FROM events)"
