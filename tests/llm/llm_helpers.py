"""Small tables and prose for the tests of this folder."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, component_id string, h1 long, spans string, score double"
WORDS = "ember lattice quarry velvet harbor cinder meadow thistle cobalt lantern willow granite saffron orchard pebble summit timber raven copper glacier".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


def table(spark, rows):
    """documents of (doc_id, text) with further columns, some named as the operators name theirs."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 7, "x", 8, "y", 0.5) for i, t in rows], SCHEMA)
