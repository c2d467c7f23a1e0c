"""Names in any script against Python's own decomposition."""

import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskledger.functions.names import MARKED, PLAIN, match_key, preclean

TABLE = dict(zip(MARKED, PLAIN))


def stripped(c):
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


def keys(spark, names):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    return [r["k"] for r in rows.select("i", match_key(F.col("n")).alias("k")).orderBy("i").collect()]


def test_names_with_and_without_marks_share_a_key(spark):
    marked = ["Świętokrzyska Hôtel", "Žďárské Strojírny", "Şişecam Gıda Güneş", "Công Ty Việt Nam Điện", "Ångström Ørsted", "Ｆｕｌｌ Ｗｉｄｔｈ Co", "Café Créme", "Straße №5"]
    plain = ["Swietokrzyska Hotel", "Zdarske Strojirny", "Sisecam Gıda Gunes", "Cong Ty Viet Nam Đien", "Angstrom Ørsted", "Full Width Co", "Cafe Creme", "Straße №5"]
    assert keys(spark, marked) == keys(spark, plain)


def test_every_character_that_becomes_one(spark):
    every = [chr(c) for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000]
    for c in every:
        want = stripped(c)
        if len(want) <= 1:
            assert TABLE.get(c, "" if c in MARKED[len(PLAIN) :] else c) == want, hex(ord(c))


@settings(max_examples=20, deadline=None)
@given(names=st.lists(st.text(st.characters(min_codepoint=0x41, max_codepoint=0x24FF, categories=["Lu", "Ll", "Mn"]), max_size=12), min_size=1, max_size=60))
def test_cleaning_against_unicodedata(spark, names):
    names = ["".join(c for c in n if len(stripped(c)) <= 1) for n in names]
    rows = spark.createDataFrame([(i, n, stripped(n)) for i, n in enumerate(names)], "i int, n string, p string")
    assert rows.filter(preclean(F.col("n")) != preclean(F.col("p"))).isEmpty()
