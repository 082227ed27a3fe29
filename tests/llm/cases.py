"""Small tables that the operator tests share."""

import random

WORDS = "alpha Beta gamma DELTA eps zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau Straße naïve мир дом 中文 x1".split()
#: Columns whose names the operators use inside; an operator must not trip over them.
CLASHING = "_id string, _text string, _key string, _norm string, size string, kept string, seed string, fp string, weight string, bytes string, _copies string, _copy string, _mix_row string, text_digest string, _digest string"


def documents(spark, rows, partitions=3):
    """rows: (doc_id, text, source)."""
    clash = tuple("x" for _ in CLASHING.split(", "))
    return spark.createDataFrame([(*r, *clash) for r in rows], f"doc_id long, text string, source string, {CLASHING}").repartition(partitions)


def sentence(rng, n, spaces=(" ",)):
    return "".join(rng.choice(WORDS) + rng.choice(spaces) for _ in range(n)).strip()


def odd_rows(seed=1, n=40):
    """Nulls, empty and blank texts, ties, repeated rows, near copies, shared passages, one very long text."""
    rng = random.Random(seed)
    shared = [sentence(rng, 30) for _ in range(3)]
    rows = [(i, f"{sentence(rng, rng.randint(0, 40), (' ', '  ', chr(10), chr(9)))} {rng.choice(shared) if i % 3 == 0 else ''} {sentence(rng, rng.randint(0, 9))}", rng.choice(["a", "a", "b", None])) for i in range(n)]
    same = sentence(rng, 50)
    rows += [(100 + i, same, "a") for i in range(6)] + [(110 + i, same.upper(), "b") for i in range(3)]
    rows += [(120, None, None), (121, "", "a"), (122, " \n\t ", "b"), (123, "one", "c"), (124, "one two three", "c"), (None, same, "a"), (None, shared[0], None)]
    rows += [rows[3], rows[3], (130, " ".join([shared[1]] * 3 + [sentence(rng, 4000)]), "b"), (131, "ab " * 60, "a"), (132, " ".join(sentence(rng, 20) for _ in range(2)) + " " + shared[2][:150], "c")]
    return rows


def words_of(text):
    return (text or "").encode().split()
