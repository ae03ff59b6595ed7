import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, label int, id long, n long, a string"
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew quiet potions beside old stone towers".split()


def prose(seed: int, n: int) -> str:
    """n words by a rule."""
    x, out = seed * 7919 + 17, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + ("" if (x >> 16) % 3 else str((x >> 20) % 50)))
    return " ".join(out)


def rows():
    line = "a shared line of more than twenty characters"
    long = prose(1, 300)
    near = long.split()
    near[150] = "changed"
    texts = [
        None, "", " ", "\n", "\n\n", "one", "two words", line, f"{line}\nown {prose(2, 40)}", f"  {line.upper()}\t\n{line}\n{prose(3, 40)}", long, long, long, " ".join(near),
        prose(4, 9), prose(4, 9) + " x", prose(5, 20000), "naïve café Größe señor — 123 ###", "$$$ %%% 12 34", "  double  spaces and trailing ", "tab\tand\r\nreturn\x0bvt", "x" * 5000,
        prose(6, 60) + "\n" + prose(7, 30), prose(6, 60) + "\n" + prose(7, 30), "<|endoftext|> literal",
    ]
    out = [(i, t, [None, "en", "de"][i % 3], [None, "s0", "s0", "s1"][i % 4], None, "k", 1, 1, 1, "a") for i, t in enumerate(texts)]
    return [*out, out[10], (None, long, "en", "s0", 3, "k", 1, 1, 1, "a"), (None, None, None, None, None, None, None, None, None, None), (-5, "negative id " + prose(9, 30), "en", "", 0, "k", 0, 0, 0, "b")]


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    """Nulls in every column, empty and very long texts, ties, repeated rows and clashing names, on disk."""
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows(), SCHEMA).repartition(5).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
