import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, words string, `row` int, nid string"


def prose(rnd, n, letters="abcdefgh"):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, a shared passage, personal data, odd characters, and nothing at all."""
    rnd = random.Random(3)
    base = [prose(rnd, rnd.randint(20, 120)) for _ in range(40)]
    passage = prose(rnd, 70)
    near = []
    for t in base[:12]:
        w = t.split()
        w[len(w) // 2] = "CHANGED"
        near.append(" ".join(w))
    chain = [" ".join(base[0].split()[k:] + ["tail%d" % j for j in range(k)]) for k in (2, 4, 6, 8)]
    shared = [prose(rnd, 30) + "\n" + passage + "\n" + prose(rnd, 30) for _ in range(8)]
    mail = ["%s joe.x@mail.example.org quietly %s" % (prose(rnd, 8), prose(rnd, 25)) for _ in range(4)]
    mail += ["gwendolyn wrote joe.x@mail.example.org to gwendolyn" + prose(rnd, 22) for _ in range(4)]
    odd = [
        None,
        "",
        " \n\t ",
        "one",
        "two words",
        "\n".join(["x y"] * 9),
        "É ß ① ½ \x1c 😀 it's 'll <|endoftext|> ok",
        "a" * 5000,
        "1 2 " * 3000,
        "a.b." * 3000 + "@c",
        "+1 (555) 123-4567 4111 1111 1111 1111 999.1.1.1 10.0.0.256 10.0.0.25 x@y.z.w ..@a.b",
        "long " + prose(rnd, 4000),
    ]
    return base + near + chain + shared + mail + odd + base[:5] * 3 + [base[20]] * 30


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Extra columns carry names that operators use inside; ids repeat and are null."""
    rows = [(i, t, "en" if i % 3 else None, "src0" if i % 2 else None, 0, "w", 1, "n") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3]]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
