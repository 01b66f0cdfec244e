"""The same operators as SQL text, to hold the DataFrame queries against on another engine (lambda x: ... dialect, RE2)."""

from __future__ import annotations

from ..functions.hashing import PRIME, WORD
from ..functions.stopwords import LANGUAGES, stopwords
from ..functions.text import KANA, SPACE, TRIGGERS

_BS = SPACE


def normalise(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}{_BS}]', '', 'g'), '[{_BS}]+', ' ', 'g'))"


def words(c: str) -> str:
    return f"list_filter(string_split({normalise(c)}, ' '), lambda w: length(w) >= 3 AND length(w) < 50 AND regexp_full_match(w, '[a-zA-ZÀ-ÿ]+'))"


def language(c: str) -> str:
    cases = " ".join(rf"WHEN regexp_matches(lower({c}), '\b({'|'.join(ws.split())})\b') THEN '{lang}'" for lang, ws in TRIGGERS.items())
    return f"CASE {cases} WHEN regexp_matches({c}, '{KANA}') THEN 'ja' ELSE 'en' END"


def drop(tokens: str, lang: str) -> str:
    def own(code: str) -> str:
        listed = ", ".join("'" + w.replace("'", "''") + "'" for w in stopwords(code))
        return f"list_filter({tokens}, lambda t: length(trim(t)) >= 3 AND regexp_full_match(t, '[a-zA-ZÀ-ÿ]+')" + (f" AND lower(t) NOT IN ({listed}))" if listed else ")")

    return f"CASE {lang} " + " ".join(f"WHEN '{code}' THEN {own(code)}" for code in LANGUAGES) + " END"


def tokens(table: str = "documents", key: str = "doc_id", name: str = "tok", extra: str = "") -> str:
    """CTEs that end with name: key, text, tokens (and extra columns)."""
    more = f", {extra}" if extra else ""
    return f"""{name}_w AS (SELECT {key}, coalesce(text, '') AS text{more}, {words("coalesce(text, '')")} AS w FROM {table}),
{name}_l AS (SELECT *, {language("array_to_string(w, ' ')")} AS lang FROM {name}_w),
{name} AS MATERIALIZED (SELECT {key}, text{more}, {drop("w", "lang")} AS tokens FROM {name}_l)"""


def vectors(source: str, target: str) -> str:
    """CTEs from s_doc and t_doc (id, tokens) to sim (src, tgt, sim)."""
    return f"""s_doc AS ({source}), t_doc AS ({target}),
s_tf AS (SELECT id, term, 1 + ln(count(*)::DOUBLE) AS tf FROM (SELECT id, unnest(tokens) AS term FROM s_doc) GROUP BY ALL),
t_tf AS (SELECT id, term, 1 + ln(count(*)::DOUBLE) AS tf FROM (SELECT id, unnest(tokens) AS term FROM t_doc) GROUP BY ALL),
idf AS (SELECT term, ln(((SELECT count(*) FROM t_doc)::DOUBLE + 1) / (count(*) + 1)) + 1 AS idf FROM t_tf GROUP BY term),
s_w AS MATERIALIZED (SELECT id, term, tf * idf AS w FROM s_tf JOIN idf USING (term)),
t_w AS MATERIALIZED (SELECT id, term, tf * idf AS w FROM t_tf JOIN idf USING (term)),
s_n AS (SELECT id, sqrt(sum(w * w)) AS n FROM s_w GROUP BY id), t_n AS (SELECT id, sqrt(sum(w * w)) AS n FROM t_w GROUP BY id),
dots AS (SELECT s.id AS src, t.id AS tgt, sum(s.w * t.w) AS dot FROM s_w s JOIN t_w t USING (term) GROUP BY ALL),
sim AS MATERIALIZED (SELECT src, tgt, greatest(-1, least(1, dot / (s_n.n * t_n.n))) AS sim FROM dots JOIN s_n ON s_n.id = src JOIN t_n ON t_n.id = tgt)"""


BEST = "best AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(sim, 9) DESC, tgt) AS rank FROM sim WHERE sim >= 0.01 QUALIFY rank <= 5)"


def topics(tok: str = "tok", key: str = "doc_id", name: str = "top") -> str:
    """CTEs that end with name: key, rank, term, n."""
    return f"""{name}_l AS (SELECT *, {language("array_to_string(tokens, ' ')")} AS lang2 FROM {tok}),
{name}_c AS (SELECT {key}, lower(trim(t)) AS term, count(*) AS n FROM (SELECT {key}, unnest({drop("tokens", "lang2")}) AS t FROM {name}_l) GROUP BY ALL),
{name} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, term) AS rank FROM {name}_c QUALIFY rank <= 5),
{name}_list AS MATERIALIZED (SELECT {key}, list(term ORDER BY rank) AS topics FROM {name} GROUP BY {key})"""


def anchor(c: str) -> str:
    """Of a column text: needs no CTE."""
    joined = "array_to_string(b, ' ')"
    base = f"list_filter(string_split({normalise(c)}, ' '), lambda w: length(w) >= 3)"
    return f"(SELECT CASE WHEN len(f) = 0 THEN substr({c}, 1, 30) ELSE array_to_string(f[1:3], ' ') END FROM (SELECT {drop('b', 'l')} AS f FROM (SELECT b, {language(joined)} AS l FROM (SELECT {base} AS b))))"


def polynomial(text: str, start: int, modulus: int) -> str:
    return f"list_reduce(list_transform(string_split({text}, ''), lambda c: ord(c)::BIGINT), lambda a, c: (a * 31 + c) % {modulus}, {start}::BIGINT)"


def padded(text: str) -> str:
    powers = ", ".join(str(pow(31, i, PRIME)) for i in range(257))
    return f"(({polynomial(f'substr({text}, 1, 256)', 0, PRIME)})::HUGEINT * [{powers}][257 - length(substr({text}, 1, 256))] % {PRIME})::BIGINT"


def signature(n: int) -> str:
    shift = [31 * (i + 1) * pow(31, 256, PRIME) % PRIME for i in range(n)]
    return "[" + ", ".join(f"min((v + {a}) % {PRIME} % {WORD})" for a in shift) + "]"
