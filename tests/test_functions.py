import math

import pytest
from pyspark.sql import functions as F

from vigil.functions import numeric as N
from vigil.functions import predicates as P
from vigil.functions import text as T


def one(spark, col, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


@pytest.mark.parametrize("s,expected", [("", 0.0), ("aaaaaaaaaa", 0.0), ("hellohello", 1.9219), ("requests.post", 3.0270)])
def test_entropy_goldens(spark, s, expected):
    assert round(one(spark, T.shannon_entropy("s"), s), 4) == expected


def test_entropy_matches_python_on_unicode(spark):
    from collections import Counter
    s = "héllo 😀😀 wörld\nß"
    c = Counter(s)
    exp = -sum(v / len(s) * math.log2(v / len(s)) for v in c.values())
    assert abs(one(spark, T.shannon_entropy("s"), s) - exp) < 1e-12


@pytest.mark.parametrize("x,expected", [(-60, 0.0), (-5, 0.0067), (0, 0.5), (5, 0.9933), (60, 1.0)])
def test_sigmoid(spark, x, expected):
    assert round(one(spark, N.sigmoid("x"), float(x), "x double"), 4) == expected


def test_blake2b_buckets():
    assert T.blake2b_buckets(["requests.post", None, "subprocess.Popen", "pickle.loads"], 128) == [10, None, 66, 40]


def test_blake2b_udf_matches(spark):
    df = spark.createDataFrame([("requests.post",), ("subprocess.Popen",), ("pickle.loads",)], "s string")
    assert [r["b"] for r in df.select(T.bucket("s", 128, "blake2b").alias("b")).collect()] == [10, 66, 40]


def test_embed_tokens(spark):
    toks = one(spark, T.embed_tokens("s"), "see https://a.b/c 1234567890abcdef12 x1")
    assert toks == ["see", "https", "1234567890abcdef12", "x1"]


@pytest.mark.parametrize("name,expected", [
    ("subprocess.Popen", True), ("re.compile", True), ("self.open", True), ("retrieval", True),
    ("filesystem", True), ("modules.system", True), ("socket.socket", True), ("math.floor", False), ("", False)])
def test_sensitive_call(spark, name, expected):
    assert one(spark, P.is_sensitive_call("s"), name) is expected


@pytest.mark.parametrize("name,expected", [
    ("subprocess", True), ("xml.dom.minidom", True), ("XML.DOM.MINIDOM.x", True), ("xml", False),
    ("crypto.cipher.aes", True), ("pickles", False)])
def test_sensitive_import(spark, name, expected):
    assert one(spark, P.is_sensitive_import("s"), name) is expected


def test_attention_cases(spark):
    rows = [(1.0, 1.0, 1.0), (1.0, 0.0, 1.0), (0.0, 1.0, 0.0), (0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = [[round(x, 4) for x in r["s"]] for r in df.select(N.softmax3("a", "b", "c").alias("s")).collect()]
    assert got[0] == [0.3333] * 3
    assert got[1] == [0.4223, 0.1554, 0.4223]
    assert got[2] == [0.2119, 0.5761, 0.2119]
    assert got[3] == [0.3333] * 3


def test_utf8_replacement_and_newlines(spark):
    from vigil.sources.files import decode_text
    raw = b"ab\xff\xe2\x82c\xf0\x9f"
    got = one(spark, decode_text("b"), bytearray(raw), "b binary")
    assert got == raw.decode("utf-8", errors="replace")
    assert one(spark, decode_text("b"), bytearray(b"a\r\nb\rc"), "b binary").split("\n") == ["a", "b", "c"]


def test_collapse_whitespace(spark):
    assert one(spark, T.collapse_whitespace("s"), "  a \t b\u3000c\x1c d \n") == "a b c d"


def test_keyword_counts(spark):
    s = "payload = base64.b64decode(x); exfiltration via cmd.exe"
    assert one(spark, T.keyword_occurrence_count("s"), s) == sum(s.lower().count(w) for w in __import__(
        "vigil.functions.vocab", fromlist=["x"]).SUSPICIOUS_WORDS)


def test_skipped_dirs(spark):
    from vigil.sources.files import path_is_kept
    df = spark.createDataFrame([("build/x.py",), (".eggs-1/x.py",), ("a/dist/x.py",), ("a/build.py",)], "p string")
    assert [r["p"] for r in df.where(path_is_kept("p")).collect()] == ["a/build.py"]


def test_split_lines(spark):
    assert one(spark, T.split_lines("s"), "a\n\nb\n") == "a\n\nb\n".splitlines()
    assert one(spark, T.split_lines("s"), "") == []
