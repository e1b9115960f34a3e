import hashlib
import hmac
import math
import uuid

import pytest
from pyspark.sql import functions as F

from quarryline.functions import maths as M
from quarryline.functions import text as X
from quarryline.operators import aggregates


def one(spark, c, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(c.alias("x")).first()[0]


def test_tokens_and_words(spark):
    assert one(spark, X.tokens("t"), t="Élan_1, über 3.5%!") == ["Élan_1", ",", "über", "3", ".", "5", "%", "!"]
    assert one(spark, X.token_count("t"), t="") == 0
    assert one(spark, X.words("t"), t="A-b É") == ["a", "b", "é"]


def test_sentences(spark):
    assert one(spark, X.sentences("t"), t="One. Two! three. (Four)") == ["One.", "Two! three.", "(Four)"]


def test_slug_excerpt_breadcrumb(spark):
    assert one(spark, X.slug("t"), t="--A  b/Ç.pdf") == "a-b-pdf"
    assert one(spark, X.excerpt("t", 5), t=" a  bcdefg ") == "a bcd..."
    assert one(spark, X.breadcrumb("t", F.array(F.lit("T"), F.lit("a"), F.lit(""))), t="T") == "T > a"
    assert one(spark, X.around("t", "MID", 2), t="abcmidxyz") == "...bcmidxy..."
    assert one(spark, X.around("t", "no"), t="abc") is None


def test_heading_depth(spark):
    assert [one(spark, X.heading_depth("t"), t=t) for t in ("1. a", "1.2.3 b", "x", "1.1.1.1.1.1.1 z")] == [1, 3, None, 6]


def test_uuid5_and_hmac(spark):
    assert one(spark, X.uuid5(uuid.NAMESPACE_URL.hex, F.col("t")), t="doc:é") == str(uuid.uuid5(uuid.NAMESPACE_URL, "doc:é"))
    assert one(spark, X.hmac_sha256(b"k", F.col("t")), t="message") == hmac.new(b"k", b"message", "sha256").hexdigest()
    long = b"k" * 100
    assert one(spark, X.hmac_sha256(long, F.col("t")), t="m") == hmac.new(long, b"m", hashlib.sha256).hexdigest()


def test_normalize(spark):
    assert one(spark, X.normalize_text("t"), t="cus-\r\ntomer  ﬁle\n\n x­y") == "customer file xy"
    assert one(spark, X.normalize_text("t", lines=True), t="a\n\nb ") == "a\nb"


@pytest.mark.parametrize("score,state", [(math.log(0.3 / 0.7), "confident"), (math.log(0.15 / 0.85) + 1e-12, "low_confidence"), (math.log(0.15 / 0.85) - 0.01, "insufficient"), (-800.0, "insufficient"), (800.0, "confident")])
def test_bands(spark, score, state):
    assert one(spark, M.band(M.sigmoid("s") + 1e-15), s=score) == state


def test_cosine(spark):
    assert one(spark, M.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(0.5**0.5)
    assert one(spark, M.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None


def test_nearest_rank(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (5, 1, 2, 2, 9)] + [("a", None), ("b", 7.0), ("c", None)], "k string, v double")
    got = {r["k"]: (r["p50"], r["p95"]) for r in aggregates.nearest_rank(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    assert got == {"a": (2.0, 9.0), "b": (7.0, 7.0)}


def test_logistic_fit(spark):
    import random

    random.seed(3)
    xs = [random.gauss(0, 1.5) for _ in range(400)]
    rows = [(x, float(random.random() < 1 / (1 + math.exp(-(2 * x - 0.5))))) for x in xs]
    a, b, n, _ = aggregates.logistic_fit(spark.createDataFrame(rows, "x double, y double"), "x", "y")
    assert n == 400 and 1.3 < a < 2.9 and -1.2 < b < 0.2
    with pytest.raises(ValueError):
        aggregates.logistic_fit(spark.createDataFrame(rows[:10], "x double, y double"), "x", "y")
    with pytest.raises(ValueError):
        aggregates.logistic_fit(spark.createDataFrame([(1.0, 1.0)] * 30, "x double, y double"), "x", "y")
