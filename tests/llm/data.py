"""Small documents for the tests: prose of three invented languages, copies, nulls, long and empty texts."""

from __future__ import annotations

import random

WORDS = {
    "en": ["the", "thing", "whether", "other", "with", "wholly", "shore", "thorn", "weather", "worth"],
    "fr": ["le", "oiseau", "beau", "château", "eux", "nouveaux", "forêt", "élève", "chez", "cœur"],
    "de": ["der", "schön", "straße", "zwischen", "über", "nicht", "pferd", "kopf", "größe", "ich"],
}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(draw: random.Random, lang: str, words: int) -> str:
    return " ".join(draw.choice(WORDS[lang]) + draw.choice(["", "", "", ",", "."]) for _ in range(words))


def rows(n: int = 120, seed: int = 1) -> list[tuple]:
    """Documents with every odd case; ids are not dense and not in order."""
    draw = random.Random(seed)
    out = []
    for i in range(n):
        lang = draw.choice(list(WORDS))
        out.append((i * 3, prose(draw, lang, draw.choice([1, 4, 30, 80, 200])), lang))
    out += [(1000, None, "en"), (1001, "", "fr"), (1002, " \n\t ", None), (1003, "12345 !!! ###", "en"), (1004, out[5][1], out[5][2]), (1005, out[5][1], None), (1006, "x" * 30_000, "en"), (1007, prose(draw, "de", 6000), "de"), (1008, "a<|endoftext|>b  c", "en"), (1009, "日本語のテキスト Ünïcode ﬁ ẞ 🙂", "en")]
    draw.shuffle(out)
    return [(i, t, lang, "s", len(t or "")) for i, t, lang in out]


def frame(spark, data=None, extra: bool = True):
    """As a table in a few partitions, with columns whose names operators use themselves."""
    df = spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("clash") for c in ("score", "rep", "key", "length", "range", "host", "words", "n", "a", "place")})
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
