import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from demandlens import schemas as S
from demandlens.functions import privacy as P

KEYS = ("00" * 32, "11" * 32)


def pseudonyms(spark, names, key):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    rows = df.select("i", P.pseudonymize(F.col("n"), key).alias("p")).orderBy("i").collect()
    return [row["p"] for row in rows]


def test_pseudonyms_are_keyed_hashes(spark):
    names = ["melomaniac", "crate_digger", "ünïcode 名前", ""]
    for key in KEYS:
        expected = [
            hmac.new(bytes.fromhex(key), name.encode(), hashlib.sha256).digest()[:8].hex()
            for name in names
        ]
        assert pseudonyms(spark, names, key) == expected


def test_stable_and_key_dependent(spark):
    first, again = (pseudonyms(spark, ["melomaniac"], KEYS[0]) for _ in range(2))
    assert first == again != pseudonyms(spark, ["melomaniac"], KEYS[1])
    assert "melomaniac" not in first[0] and len(first[0]) == 16


@pytest.mark.parametrize("key", ["", "00" * 16, "not hex at all"])
def test_bad_keys(key):
    with pytest.raises(ValueError):
        P.decode_key(key)


def test_no_layout_holds_user_names(spark):
    layouts = [S.RAW_SCHEMA, S.PARSED_SCHEMA, S.CATALOGUE_SCHEMA, S.hourly_schema("artist_name")]
    for layout in layouts:
        S.refuse_usernames(spark.createDataFrame([], layout))
    for name in ("username", "User_Name", "searcher_username"):
        with pytest.raises(ValueError):
            S.refuse_usernames(spark.createDataFrame([], f"{name} string"))
