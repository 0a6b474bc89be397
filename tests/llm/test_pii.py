"""op10 on odd names and on very long matches."""

import re

import pytest

from skein.llm import pii


def made(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r.text for r in pii.pseudonymise(df, "k").orderBy("doc_id").collect()]


N = 100_000
LONG = {
    "labels": "x@" + "a." * N + "com",
    "label": "x@" + "a" * N + ".com",
    "local part": "a" * N + "@x.org",
    "dotted local part": "a." * N + "b@x.org",
    "name": "Mr. A" + "b" * N,
    "hyphens": "Mr. A" + "-b" * N,
    "astral letters": "Mr. A" + "\U00010400" * N,
    "initials": "Mr. " + "J. " * N + "Smith",
    "digits": "1" * N,
    "groups of four": "1234 " * (N // 10),
    "phone": "+1" + " 23" * N,
    "bank account": "GB82" + " WEST" * N,
    "octets": "1." * N + "1",
    "names": "Mr. Smith " * 2000,
    "at signs": "@" * N,
    "hyphened numbers": "123-45-" * N,
}


@pytest.mark.parametrize("kind", LONG)
def test_very_long_matches(spark, kind):
    got = made(spark, LONG[kind], "mail a@b.org now")
    assert got[0] and re.fullmatch(r"mail \S+@\S+\.example\.org now", got[1])
    if kind in ("local part", "dotted local part", "name", "hyphens", "astral letters", "label", "names"):
        assert got[0] != LONG[kind]


def test_titles_in_capitals_and_initials(spark):
    got = made(spark, "MR. JOHN SMITH and Mr. John Smith", "Mr. J. R. Smith, then Dr. J.R. Smith and Smith.", "MRS. ANNA JONES")
    a = re.fullmatch(r"MR\. (\S+) (\S+) and Mr\. (\S+) (\S+)", got[0])
    assert a and a[3].upper() == a[1] != "JOHN" and a[4].upper() == a[2] != "SMITH" and a[3] in pii.MALE_NAMES
    b = re.fullmatch(r"Mr\. (\w)\. (\w)\. (\S+), then Dr\. (\w)\.(\w)\. (\S+) and (\S+)\.", got[1])
    assert b and b[3] == b[6] == b[7] == a[4] and b.group(1, 2) == b.group(4, 5)
    c = re.fullmatch(r"MRS\. (\S+) (\S+)", got[2])
    assert c and c[1].capitalize() in pii.FEMALE_NAMES


def test_ordinary_words_stay_at_the_beginning_of_sentences(spark):
    got = made(spark, "Mr. Will Young came. Will he stay? They will, and so will Will. Young left.")[0]
    m = re.fullmatch(r"Mr\. (\S+) (\S+) came\. Will he stay\? They will, and so will (\S+)\. (\S+) left\.", got)
    assert m and m[3] == m[1] != "Will" and m[4] == m[2] != "Young"
