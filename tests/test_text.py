"""White space in the Unicode sense."""

from pyspark.sql import functions as F

from docsheaf.functions.text import rstrip, squeeze, strip, strip_newlines


def test_white_space_is_that_of_unicode(spark):
    """Against the engine's own class, for every character of the basic plane."""
    marks = [chr(k) for k in range(1, 0x10000) if not 0xD800 <= k < 0xE000]
    rows = [(c, f"{c}{c} a {c}b{c}\n{c}") for c in marks] + [("", ""), ("", " \n\t "), ("", "a")]
    df = spark.createDataFrame(rows, "c string, t string")
    t = F.col("t")
    plain = {
        "strip": F.regexp_replace(t, r"(?U)^\s+|\s+$", ""), "rstrip": F.regexp_replace(t, r"(?U)\s+$", ""), "newlines": F.regexp_replace(t, r"^\n+|\n+\z", ""),
        "squeeze": F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", " "), r"^ +| +\z", ""),
    }
    own = {"strip": strip(t), "rstrip": rstrip(t), "newlines": strip_newlines(t), "squeeze": squeeze(t)}
    differ = df.select("c", *[(own[k] != plain[k]).alias(k) for k in own]).filter(" or ".join(own))
    assert differ.collect() == []
    assert df.filter(strip(F.col("t")) == "a").count() == 1 and df.select(strip(F.lit(None).cast("string")).alias("x")).first().x is None
