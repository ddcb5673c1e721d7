"""Quality rules on texts that the tables don't hold, with references learned from the tables."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from movelines.llm import rules

RECIPE = """Preheat the oven to 180 degrees. Grease a round cake tin and line the base with baking paper. Beat the butter and
sugar until pale and fluffy, then add the eggs one at a time, beating well after each. Fold in the flour, cocoa powder and a pinch of
salt, alternating with the milk, until the batter is smooth. Pour into the tin and bake for 35 minutes, or until a skewer comes out
clean. Leave to cool for ten minutes before turning out onto a wire rack. For the icing, melt the chocolate with the cream over a low
heat, stir until glossy, and spread over the cooled cake with a palette knife."""
DUTCH = """Het was een koude ochtend in de herfst toen de oude man zijn huis verliet om naar de markt te gaan. Hij liep langzaam door
de smalle straten, waar de winkels nog gesloten waren en alleen de bakker al licht had branden. Op het plein zag hij een groep kinderen
die met een bal speelden, terwijl hun moeders bij de fontein stonden te praten. Hij kocht brood, kaas en een paar appels, en dacht aan
de tijd dat hij zelf nog jong was en elke dag met zijn broer naar school fietste. Niemand in het dorp wist hoe oud hij precies was."""
ITALIAN = """Era una mattina fredda quando il vecchio uscì di casa per andare al mercato. Camminava lentamente per le strade strette,
dove i negozi erano ancora chiusi e soltanto il fornaio aveva già la luce accesa. Nella piazza vide un gruppo di bambini che giocavano
con una palla, mentre le loro madri parlavano vicino alla fontana. Comprò del pane, del formaggio e qualche mela, e pensò al tempo in
cui era giovane e ogni giorno andava a scuola in bicicletta con suo fratello. Nessuno nel paese sapeva quanti anni avesse, ma tutti."""
RUSSIAN = """Холодным осенним утром старый человек вышел из дома и медленно пошёл на рынок по узким улицам, где лавки были ещё закрыты и
только у пекаря горел свет. На площади дети играли в мяч, а их матери разговаривали у фонтана. Он купил хлеб, сыр и несколько яблок,
вспоминая время, когда сам был молод и каждый день ездил с братом в школу на велосипеде. Никто в деревне не знал, сколько ему лет."""
_letters = random.Random(1)
NOISE = " ".join("".join(_letters.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(_letters.randint(2, 9))) for _ in range(150))
STARRED = " ".join(w + "***" for w in DUTCH.split())


@pytest.fixture(scope="module")
def verdicts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    new = [RECIPE, DUTCH, ITALIAN, RUSSIAN, NOISE, STARRED]
    more = spark.createDataFrame([(-k, t, None) for k, t in enumerate(new, 1)], "doc_id long, text string, lang string")
    return {r["doc_id"]: r for r in rules.quality_rules(docs.union(more)).collect()}


def test_clean_texts_of_any_language_stay(verdicts):
    assert [verdicts[-k]["kept"] for k in (1, 2, 3, 4)] == [True] * 4
    assert not any(verdicts[-k]["base_failed"] for k in range(1, 7))


def test_letters_at_random_and_symbols_go(verdicts):
    assert not verdicts[-5]["kept"] and not verdicts[-6]["kept"]
    assert verdicts[-5]["word_distance"] > verdicts[-1]["word_distance"] + 0.1


def test_labelled_texts(spark, verdicts):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    kept = {q: [verdicts[r["doc_id"]]["kept"] for r in labels if r["quality"] == q] for q in (0, 1)}
    assert sum(kept[1]) >= 0.97 * len(kept[1]) and sum(kept[0]) <= 0.05 * len(kept[0])


def test_word_counts(spark):
    texts = [RECIPE, DUTCH, "", None, "The the. THE, a a&&&b *** ||", "longer than-six letters"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", rules.word_counts(F.col("t")).alias("c")).collect()
    for r in got:
        tokens = re.findall(r'[^\x20\x09-\x0D.,;:!?"()\[\]{}<>|#*$%&+=~^_/\\@]+', (texts[r["k"]] or "").lower())
        assert r["c"]["total"] == len(tokens)
        assert {x["w"]: x["n"] for x in r["c"]["short"]} == Counter(w for w in tokens if len(w) <= 6)


def test_divergence_by_its_definition(spark):
    refs = [{"lang": "x", "chars": [1, 1, 1, 1, 1], "beyond": False, "words": {"a": 30, "b": 20, "c": 10}, "common": 60, "total": 200}]
    counts = {"a": 4, "c": 2, "z": 9}
    one = spark.range(1).select(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(n).alias("n")) for w, n in counts.items()]).alias("c"))
    got = one.select(rules.nearest_words(F.col("c"), F.lit(20), rules._literal(refs)).alias("v")).first()["v"]
    p, q = [4 / 20, 0, 2 / 20, 14 / 20], [30 / 200, 20 / 200, 10 / 200, 140 / 200]
    part = lambda v, w: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(v, w) if x)
    assert got["divergence"] == pytest.approx((part(p, q) + part(q, p)) / 2 - 3 / (8 * math.log(2) * 20))
    assert got["lang"] == "x" and got["share"] == pytest.approx(6 / 20)
