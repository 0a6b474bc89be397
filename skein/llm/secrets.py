"""Secret scan with multipart credential linking, from SQL functions alone.

Base spans stand by themselves: assignments of secrets, access identifiers,
long hexadecimal strings. Weak candidates (logins, key-like strings,
endpoints) are reported only when complementary parts stand within SCOPE code
points in the same text: a login near a secret, a key near an identifier, an
endpoint near both. Parts are joined by their intervals inside the row, by
halving in the sorted spans of each kind, so that nothing is shuffled and no
pairs of spans are formed.

Edge cases: a null text counts as empty; long texts are scanned whole;
repeated rows are scanned each; an empty table gives no rows; a key that
overlaps a base span is not reported twice; columns of the caller are kept
where asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.spans import either_case, near, none, pieces, placed

# The kinds, in the order of reports.
KINDS = ("assign", "access", "hex", "login", "key", "endpoint")
SECRET_WORDS = ("password", "passwd", "secret", "token", "api_?key")
LOGIN_WORDS = ("user", "username", "login", "client_?id", "account_?id")
HOST_WORDS = ("host", "hostname", "endpoint", "server", "url")


def _named(names: Sequence[str], value: str) -> str:
    return "(" + "|".join(map(either_case, names)) + r""")["']?\x20*[:=]\x20*["']?(""" + value + ")"


ASSIGN = _named(SECRET_WORDS, "[A-Za-z0-9+/_.=-]+")
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
LOGIN = _named(LOGIN_WORDS, "[A-Za-z0-9@._-]{3,}")
KEY = "[A-Za-z0-9+/_=-]{20,}"
ENDPOINT = r"""https?://[^\x00-\x20"'<>]+|""" + _named(HOST_WORDS, r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?")
#: Code points between parts that belong together.
SCOPE = 256


def _near(span: Column, kinds: Sequence[str], scope: int) -> Column:
    found = F.lit(False)
    for kind in kinds:
        found = found | near(span, F.col(kind), scope)
    return found


def _spans(text: Column, pattern: str, when: Column | None = None) -> Column:
    found = placed(*pieces(text, pattern))
    test = text.rlike(pattern)
    return F.when(test if when is None else when & test, found).otherwise(none())


def scan(documents: DataFrame, scope: int = SCOPE, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keep, and an array of spans (start, end) of each kind."""
    t = F.col("_text")
    df = documents.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    matches, gaps = pieces(t, ASSIGN)
    long = F.transform(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 8)
    df = df.withColumns({"assign": F.when(t.rlike(ASSIGN), placed(matches, gaps, long)).otherwise(none()), "access": _spans(t, ACCESS), "hex": _spans(t, HEX), "login": _spans(t, LOGIN)})
    identified = (F.size("access") > 0) | (F.size("login") > 0)
    # Key-like strings have a digit and a letter, and are not reported already.
    matches, gaps = pieces(t, KEY)
    mixed = F.transform(matches, lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"))
    keys = F.when(identified & t.rlike(KEY), placed(matches, gaps, mixed)).otherwise(none())
    df = df.withColumns({"key": keys, "endpoint": _spans(t, ENDPOINT, identified)}).drop("_text")
    df = df.withColumn("key", F.filter("key", lambda k: ~_near(k, KINDS[:3], -1)))
    ids = ("access", "login")
    # What is linked is judged by all candidates of the complementary kinds, whether these are linked or not.
    linked = {
        "login": F.filter("login", lambda x: _near(x, ("assign", "hex", "key"), scope)),
        "key": F.filter("key", lambda x: _near(x, ids, scope)),
        "endpoint": F.filter("endpoint", lambda x: _near(x, ("assign", "hex", "key"), scope) & _near(x, ids, scope)),
    }
    return df.withColumns(linked)


def listed(kinds: Sequence[str]) -> Column:
    """kind:start:end of all spans of the kinds, by start and then kind."""
    def tag(i: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end")))

    tagged = [tag(i, k) for i, k in enumerate(kinds)]
    names = F.array(*map(F.lit, kinds))
    text = F.transform(F.array_sort(F.concat(*tagged)), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]))
    return F.array_join(text, ",")


def report(found: DataFrame) -> DataFrame:
    counts = {f"n_{k}": F.size(k).cast("bigint") for k in KINDS[:3]}
    return found.select("doc_id", *(v.alias(k) for k, v in counts.items()), F.sha2(listed(KINDS[:3]), 256).alias("base_sha256"), listed(KINDS).alias("spans"))
