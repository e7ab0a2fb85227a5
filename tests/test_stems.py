"""Stemmers against words whose stems follow from the published rules by hand."""

import pytest
from pyspark.sql import functions as F

from sparquill.functions import stems

KNOWN = {
    "spanish_light": {"luces": "luz", "casas": "cas", "chilenos": "chilen", "inglés": "ingl", "intereses": "interes", "sol": "sol"},
    "italian_light": {"ragazzi": "ragazz", "amiche": "amic", "libertà": "libert", "città": "città", "vino": "vino"},
    "french_minimal": {"chevaux": "cheval", "parlées": "parl", "chiennes": "chien", "hiboux": "hibou", "mois": "mois"},
    "german_minimal": {"bäumen": "baum", "haus": "haus", "lehrerinnen": "lehrerin"},
    "german_light": {"häusern": "haus", "kinder": "kind", "schönest": "schon"},
    "swedish_light": {"klostrens": "klostr", "flickornas": "flick", "sak": "sak"},
    "norwegian_minimal": {"bilenes": "bil", "husene": "hus"},
    "hindi": {"लड़कियों": "लड़क", "किताबें": "किताब"},
    "arabic": {"والكتاب": "كتاب", "المدرسة": "مدرس", "ساهدهات": "ساهد", "كتابها": "كتاب"},
}


@pytest.mark.parametrize("language", sorted(stems.STEMMERS))
def test_stems(spark, language):
    own = KNOWN[language]
    df = spark.createDataFrame([(list(own),)], "t array<string>")
    assert df.select(stems.stemmed(F.col("t"), language)).first()[0] == list(own.values())


def test_normalisation(spark):
    one = lambda f, x: spark.createDataFrame([([x],)], "t array<string>").select(f(F.col("t"))).first()[0][0]
    assert one(stems.normalize_arabic, "آباءِ") == "اباء" and one(stems.normalize_persian, "یک") == "يك"
    assert one(stems.fold_width, "ＡＢ１！中") == "AB1!中"


def test_bigrams_and_maps(spark):
    df = spark.createDataFrame([("東京都 ab テ, x1",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(stems.cjk_bigrams(F.col("s"))).collect()] == [["東京", "京都", "ab", "テ", "x1"], [], None]
    assert df.select(stems.map_chars(F.col("s"), {"a": "b", "ab": "c", "東": ""})).first()[0] == "京都 c テ, x1"
