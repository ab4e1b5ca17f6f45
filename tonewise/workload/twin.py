"""SQL twins: common table expressions for the SQL side of the comparison.

The scoring twin is written with windows over all tokens, on purpose unlike the Spark plan.
"""

from __future__ import annotations

from tonewise.functions import fixed_values as fixed
from tonewise.workload import fixtures as fx


def _list(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def common(*extra: str) -> str:
    """WITH clause holding the fixture tables, then any further expressions."""
    tables = {
        "tweets": f"SELECT *, regexp_matches(tweetText, '{fx.EMOJI_PATTERN}') AS contain_emoji FROM ({fx.TWEETS})",
        "lexicon": fx.LEXICON,
        "emoji_alias": fx.EMOJI_ALIAS,
        "emoji_polarity": fx.EMOJI_POLARITY,
        "word_polarity": fx.WORD_POLARITY,
        "pickups": fx.PICKUPS,
        "executions": fx.EXECUTIONS,
        "actions": fx.ACTIONS,
        "aggs": fx.AGGS,
    }
    parts = [f"{name} AS ({body})" for name, body in tables.items()]
    return "WITH " + ",\n".join(parts + [part.strip().rstrip(",") for part in extra]) + "\n"


def aliased(text: str) -> str:
    """Emoji to alias by nested replace, written out for the fixture's six emoji."""
    pairs = [("😀", ":grinning:"), ("😡", ":rage:"), ("❤", ":heart:"), ("🎉", ":tada:"), ("👍", ":+1:"), ("💔", ":broken_heart:")]
    for emoji, alias in pairs:
        text = f"replace({text}, '{emoji}', '{alias}')"
    return text


def stripped(text: str) -> str:
    return f"regexp_replace({text}, '{fx.EMOJI_PATTERN}', '', 'g')"


UPPER = r"(\p{Lu}|[Ⅰ-ⅯⒶ-Ⓩ])*"


def _boost(token: str) -> str:
    return (
        f"CASE WHEN lower({token}) IN ({_list(fixed.RAISING)}) THEN 0.293::DOUBLE "
        f"WHEN lower({token}) IN ({_list(fixed.LOWERING)}) THEN -0.293::DOUBLE END"
    )


def _idiom(phrase: str) -> str:
    whens = " ".join(f"WHEN '{words}' THEN {value}::DOUBLE" for words, value in fixed.IDIOMS.items())
    return f"CASE {phrase} {whens} END"


def _negates(token: str) -> str:
    return f"coalesce({token} IN ({_list(fixed.NEGATIONS)}) OR contains({token}, 'n''t'), false)"


def _distance(p: str, d: int, source: str) -> str:
    """Degree words, then negation, at one distance."""
    fade = {1: "1.0", 2: "0.95", 3: "0.9"}[d]
    turned = f"CASE WHEN {_negates(f'p{d}')} THEN g{d} * -0.74::DOUBLE ELSE g{d} END"
    if d == 2:
        turned = f"CASE WHEN p2 = 'never' AND p1 IN ('so','this') THEN g2 * 1.5::DOUBLE ELSE {turned} END"
    if d == 3:
        turned = (
            "CASE WHEN (p3 = 'never' AND p2 IN ('so','this')) OR p1 IN ('so','this') "
            f"THEN g3 * 1.25::DOUBLE ELSE {turned} END"
        )
    return f"""
{p}b{d} AS (SELECT *, {_boost(f'p{d}')} AS boost{d} FROM {p}{source}),
{p}c{d} AS (SELECT *, CASE WHEN {source}_v < 0 THEN -boost{d} ELSE boost{d} END AS signed{d} FROM {p}b{d}),
{p}g{d} AS (SELECT *, CASE WHEN i >= {d} AND NOT k{d} THEN {source}_v + coalesce(
    (CASE WHEN caps AND regexp_full_match(p{d}, '{UPPER}') THEN
       CASE WHEN {source}_v > 0 THEN signed{d} + 0.733::DOUBLE ELSE signed{d} - 0.733::DOUBLE END
     ELSE signed{d} END) * {fade}::DOUBLE, 0) ELSE {source}_v END AS g{d} FROM {p}c{d}),
{p}n{d} AS (SELECT *, CASE WHEN i >= {d} AND NOT k{d} THEN {turned} ELSE g{d} END AS n{d}_v FROM {p}g{d}),"""


def scorer(source: str, key: str, text: str, lexicon: str, p: str = "", stop: bool = True, full_map: bool = False) -> str:
    """Expressions up to ``<p>trace`` (per hit) and ``<p>scores`` (id, neg, neu, pos, compound)."""
    runs = _list(fixed.PUNCTUATION_RUNS)
    boosters = _list(fixed.RAISING + fixed.LOWERING)
    pair = "('just enough', 'kind of', 'sort of')"
    before_repeat = "true" if full_map else "r.k IS NULL OR b.k < r.k"
    within = "r.stop IS NULL OR s.i <= r.stop" if stop else "true"
    scanned = "CASE WHEN r.stop IS NULL THEN r.n ELSE r.stop + 1 END" if stop else "r.n"
    return f"""
{p}src AS (SELECT {key} AS id, coalesce({text}, '') AS txt FROM {source}),
{p}pieces AS (SELECT id, unnest(string_split(txt, ' ')) AS piece, generate_subscripts(string_split(txt, ' '), 1) AS n FROM {p}src),
{p}words AS (SELECT id, n, piece, translate(piece, '.!?,;:-''"', '') AS w FROM {p}pieces),
{p}bare AS (SELECT id, w, row_number() OVER (PARTITION BY id ORDER BY n) AS k,
   row_number() OVER (PARTITION BY id, w ORDER BY n) AS occ FROM {p}words WHERE length(w) > 1 OR ord(w) > 65535),
{p}rep AS (SELECT id, min(k) AS k FROM {p}bare WHERE occ > 1 GROUP BY id),
{p}known AS (SELECT b.id, b.w FROM {p}bare b LEFT JOIN {p}rep r ON b.id = r.id WHERE b.occ = 1 AND ({before_repeat})),
{p}raw AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS i, piece, w FROM {p}words
   WHERE length(piece) > 1 OR ord(piece) > 65535),
{p}tok AS (SELECT t.id, t.i, CASE WHEN k.w IS NOT NULL AND t.piece <> t.w AND (
     (starts_with(t.piece, t.w) AND substr(t.piece, length(t.w) + 1) IN ({runs})) OR
     (ends_with(t.piece, t.w) AND substr(t.piece, 1, length(t.piece) - length(t.w)) IN ({runs})))
   THEN t.w ELSE t.piece END AS tok FROM {p}raw t LEFT JOIN {p}known k ON t.id = k.id AND t.w = k.w),
{p}ctx AS (SELECT id, i, tok, lower(tok) AS low, regexp_full_match(tok, '{UPPER}') AS up,
   lag(tok, 1) OVER o AS p1, lag(tok, 2) OVER o AS p2, lag(tok, 3) OVER o AS p3,
   lead(tok, 1) OVER o AS f1, lead(tok, 2) OVER o AS f2 FROM {p}tok WINDOW o AS (PARTITION BY id ORDER BY i)),
{p}flag AS (SELECT *, low IN ({boosters}) OR (low = 'kind' AND coalesce(f1, '') = 'of') AS is_stop FROM {p}ctx),
{p}per AS (SELECT id, count(*) AS n, min(i) FILTER (WHERE is_stop) AS stop, bool_or(up) AND NOT bool_and(up) AS caps,
   coalesce(min(i) FILTER (WHERE tok = 'BUT'), min(i) FILTER (WHERE tok = 'but'), -1) AS but FROM {p}flag GROUP BY id),
{p}hit AS (SELECT s.*, r.caps, r.but, l.valence AS v5, l1.token IS NOT NULL AS k1, l2.token IS NOT NULL AS k2,
   l3.token IS NOT NULL AS k3 FROM {p}flag s JOIN {p}per r ON s.id = r.id JOIN {lexicon} l ON l.token = s.low
   LEFT JOIN {lexicon} l1 ON l1.token = lower(s.p1) LEFT JOIN {lexicon} l2 ON l2.token = lower(s.p2)
   LEFT JOIN {lexicon} l3 ON l3.token = lower(s.p3) WHERE NOT s.is_stop AND ({within})),
{p}v6 AS (SELECT *, CASE WHEN caps AND up THEN CASE WHEN v5 > 0 THEN v5 + 0.733::DOUBLE ELSE v5 - 0.733::DOUBLE END
   ELSE v5 END AS v6_v FROM {p}hit),
{_distance(p, 1, 'v6')}
{_distance(p, 2, 'n1')}
{_distance(p, 3, 'n2')}
{p}v9a AS (SELECT *, coalesce({_idiom("p1 || ' ' || tok")}, {_idiom("p2 || ' ' || p1 || ' ' || tok")},
   {_idiom("p2 || ' ' || p1")}, {_idiom("p3 || ' ' || p2 || ' ' || p1")}, {_idiom("p3 || ' ' || p2")}, n3_v) AS e1 FROM {p}n3),
{p}v9b AS (SELECT *, coalesce({_idiom("tok || ' ' || f1")}, e1) AS e2 FROM {p}v9a),
{p}v9c AS (SELECT *, coalesce({_idiom("tok || ' ' || f1 || ' ' || f2")}, e2) AS e3 FROM {p}v9b),
{p}v9 AS (SELECT *, CASE WHEN i >= 3 AND NOT k3 THEN e3 + CASE WHEN p3 || ' ' || p2 IN {pair} OR p2 || ' ' || p1 IN {pair}
   THEN -0.293::DOUBLE ELSE 0.0::DOUBLE END ELSE n3_v END AS v9 FROM {p}v9c),
{p}v10 AS (SELECT *, CASE WHEN i >= 1 AND NOT k1 AND lower(p1) = 'least' AND (i = 1 OR lower(p2) NOT IN ('at', 'very'))
   THEN v9 * -0.74::DOUBLE ELSE v9 END AS v10 FROM {p}v9),
{p}trace AS (SELECT *, CASE WHEN but >= 0 AND i < but THEN v10 * 0.5::DOUBLE WHEN but >= 0 AND i > but THEN v10 * 1.5::DOUBLE
   ELSE v10 END AS v11 FROM {p}v10),
{p}nano AS (SELECT id, v11, CAST(floor(v11 * 1e9 + 0.5) AS BIGINT) AS q FROM {p}trace),
{p}sums AS (SELECT id, CAST(sum(q) AS BIGINT) / 1e9 AS total, coalesce(sum(q + 1000000000) FILTER (WHERE v11 > 0), 0) / 1e9 AS up,
   coalesce(sum(q - 1000000000) FILTER (WHERE v11 < 0), 0) / 1e9 AS down, count(*) FILTER (WHERE v11 <> 0) AS moved
   FROM {p}nano GROUP BY id),
{p}marks AS (SELECT id, length(txt) - length(replace(txt, '!', '')) AS ex, length(txt) - length(replace(txt, '?', '')) AS qu FROM {p}src),
{p}emph AS (SELECT id, least(ex, 4) * 0.292::DOUBLE + CASE WHEN qu > 3 THEN 0.96::DOUBLE ELSE qu * 0.18::DOUBLE END AS emphasis
   FROM {p}marks),
{p}join1 AS (SELECT m.id, m.emphasis, coalesce({scanned}, 0) AS scanned, coalesce(s.total, 0) AS total, coalesce(s.up, 0) AS up,
   coalesce(s.down, 0) AS down, coalesce(s.moved, 0) AS moved
   FROM {p}emph m LEFT JOIN {p}per r ON m.id = r.id LEFT JOIN {p}sums s ON m.id = s.id),
{p}join2 AS (SELECT *, total + sign(total) * emphasis AS st, CASE WHEN up > abs(down) THEN up + emphasis ELSE up END AS gain,
   CASE WHEN up < abs(down) THEN down - emphasis ELSE down END AS loss, CAST(scanned - moved AS DOUBLE) AS flat FROM {p}join1),
{p}join3 AS (SELECT *, gain + abs(loss) + flat AS whole, st / sqrt(st * st + 15.0::DOUBLE) AS norm FROM {p}join2),
{p}scores AS (SELECT id,
   CASE WHEN scanned = 0 THEN 0.0::DOUBLE ELSE floor(abs(loss / whole) * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE END AS neg,
   CASE WHEN scanned = 0 THEN 0.0::DOUBLE ELSE floor(abs(flat / whole) * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE END AS neu,
   CASE WHEN scanned = 0 THEN 0.0::DOUBLE ELSE floor(abs(gain / whole) * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE END AS pos,
   CASE WHEN scanned = 0 THEN 0.0::DOUBLE ELSE floor(least(greatest(norm, -1.0::DOUBLE), 1.0::DOUBLE) * 10000.0::DOUBLE + 0.5)
     / 10000.0::DOUBLE END AS compound FROM {p}join3)"""


def blend(p: str = "bl_", source: str = "tweets", key: str = "tweet_id", text: str = "tweetText") -> str:
    """``<p>scores``: emoji and word scores blended two to one."""
    parts = ", ".join(
        f"(e.{c} * 2 + w.{c}) / 3 AS {c}" for c in ("neg", "neu", "pos", "compound")
    )
    return (
        scorer(source, key, text, "emoji_polarity", f"{p}e_")
        + ","
        + scorer(source, key, text, "word_polarity", f"{p}w_")
        + f",\n{p}scores AS (SELECT e.id, {parts} FROM {p}e_scores e JOIN {p}w_scores w ON e.id = w.id)"
    )


def longest_sentence(source: str, key: str, text: str, p: str = "") -> str:
    """``<p>longest`` (id, sentence), with UTF-16 lengths and the first sentence on a tie."""
    units = r"length(s) + length(regexp_replace(s, '[^\x{10000}-\x{10FFFF}]', '', 'g'))"
    return f"""
{p}cut AS (SELECT {key} AS id, string_split(regexp_replace({text}, '([.!?])[ \\t\\n\\r\\f]+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM {source}),
{p}parts AS (SELECT id, trim(unnest(ss)) AS s, generate_subscripts(ss, 1) AS n FROM {p}cut),
{p}sized AS (SELECT id, s, n, {units} AS u FROM {p}parts WHERE s <> ''),
{p}best AS (SELECT id, arg_max(s, u * 1000000 - n) AS s FROM {p}sized GROUP BY id),
{p}longest AS (SELECT t.{key} AS id, coalesce(b.s, '') AS sentence FROM {source} t LEFT JOIN {p}best b ON t.{key} = b.id)"""


def three(compound: str) -> str:
    return f"CASE WHEN {compound} >= 0.5 THEN 2.0::DOUBLE WHEN {compound} <= -0.2 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END"


def two(compound: str) -> str:
    return f"CASE WHEN {compound} >= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def five(compound: str) -> str:
    return (
        f"CASE WHEN {compound} <= -0.6 THEN 0 WHEN {compound} <= -0.2 THEN 1 WHEN {compound} < 0.5 THEN 2 "
        f"WHEN {compound} < 0.8 THEN 3 ELSE 4 END"
    )


def fold(code: str) -> str:
    return f"CASE WHEN {code} <= 1 THEN 0 WHEN {code} = 2 THEN 1 ELSE 2 END"


def bucket(key: str, seed: int = 42) -> str:
    return f"(CAST(('0x' || substr(md5(concat({key}, ':{seed}')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


def three_way(key: str, train: float = 0.6, validation: float = 0.2, seed: int = 42) -> str:
    return (
        f"CASE WHEN {bucket(key, seed)} < {train} THEN 'train' "
        f"WHEN {bucket(key, seed)} < {train} + {validation} THEN 'validation' ELSE 'classify' END"
    )
