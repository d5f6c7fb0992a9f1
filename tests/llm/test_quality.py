import random

from brute import quality_counts

from tidemark.llm import quality

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def prose(pick, words):
    return " ".join("".join(pick.choices("abcdefghij", k=pick.randint(2, 9))) for _ in range(words))


def test_counts_and_verdicts(texts_frame):
    pick = random.Random(1)
    clean = [prose(pick, pick.randint(60, 600)) for _ in range(300)]
    junk = ["*** ".join(prose(pick, 100).split()) for _ in range(60)]
    odd = [None, "", " \n ", "a a a a", "x " * 100, "é " * 60 + "\n\né\né", "one two three\n" * 40, "&" * 9000, prose(pick, 20000)]
    texts = clean + junk + odd
    langs = ["en"] * (len(clean) - 5) + [None] * 5 + ["en"] * len(junk) + [None] * len(odd)
    sources = ["big"] * 200 + ["rare"] * 3 + [None] * (len(texts) - 203)
    rows = quality.judge(texts_frame(texts, lang=langs, source=sources)).orderBy("doc_id").collect()
    assert [tuple(row[c] for c in COUNTS) for row in rows] == [quality_counts(text) for text in texts]
    for row in rows:
        assert row.base_failed == (row.n_words < 50 or 100 * row.n_repeat_words > 50 * row.n_words)
    assert all(row.kept for row in rows[: len(clean)]) and rows[-1].kept
    assert not any(row.kept for row in rows[len(clean) : len(clean) + len(junk)])
    assert all(row.distance is None for row in rows if row.base_failed)


def test_labelled_documents(small):
    labels = {row.doc_id: row.quality for row in small("labels").collect()}
    rows = quality.judge(small("documents")).where("NOT base_failed").collect()
    assert all(row.kept == (labels[row.doc_id] == 1) for row in rows if row.doc_id in labels)


def test_planted_repeats_beside_clean_documents(texts_frame):
    """Repeats below the fixed limit stand out where the others have none; one line said twice does not."""
    pick = random.Random(5)
    clean = [prose(pick, pick.randint(60, 600)) for _ in range(150)]
    advert = [f"{prose(pick, words)} {'buy it here now ' * (words // 5)}" for words in (120, 140, 300, 600)]
    line = prose(pick, 9)
    twice = [f"{line}\n{prose(pick, words)}\n{line}" for words in (50, 100, 300)]
    rows = quality.judge(texts_frame(clean + advert + twice)).orderBy("doc_id").collect()
    assert not any(row.base_failed for row in rows)
    assert [row.kept for row in rows] == [True] * 150 + [False] * 4 + [True] * 3


def test_estimated_scatter_decides(texts_frame):
    """The same word length is an outlier in a narrow source and none in a wide one."""
    pick = random.Random(6)

    def spread(length, words=400):
        return " ".join("".join(pick.choices("abcdefghij", k=round(pick.gauss(length, 1)) or 1)) for _ in range(words))

    narrow, wide = [spread(6) for _ in range(100)], [spread(pick.uniform(4, 9)) for _ in range(100)]
    texts = [*narrow, spread(8), *wide, spread(8)]
    rows = quality.judge(texts_frame(texts, source=["narrow"] * 101 + ["wide"] * 101)).orderBy("doc_id").collect()
    assert (rows[100].kept, rows[-1].kept) == (False, True)


def test_determinant_fit_against_plain_numpy(texts_frame, monkeypatch):
    """The last fit's mean is that of the half nearest to the fit before, as numpy finds it."""
    import numpy as np

    pick = random.Random(3)
    docs = texts_frame([prose(pick, pick.randint(60, 300)) for _ in range(120)])
    fits = []
    real = quality._concentrate
    monkeypatch.setattr(quality, "_concentrate", lambda rows, fit: fits.append((rows, fit, out := real(rows, fit))) or out)
    quality.judge(docs)
    rows, before, after = fits[-1]
    x = np.array([[row[c] for c in quality.STATISTICS] for row in rows.collect()])
    old, new = before.first(), after.first()
    size = len(quality.STATISTICS)
    white = np.array(old.white).reshape(size, size)
    cells = np.floor(quality.CELLS * np.log2(1 + (((x - old.mean) @ white.T) ** 2).sum(1)))
    near = x[cells <= np.sort(cells)[int(np.ceil(len(x) / 2)) - 1]]
    assert np.allclose(near.mean(0), new.mean, atol=1e-9)


def test_chi_squared():
    assert abs(quality.chi2_quantile(0.95, 4) - 9.487729) < 1e-5
    assert abs(quality.chi2_quantile(0.5, 4) - 3.356694) < 1e-5


def test_chi_squared_of_odd_degrees():
    for dof, found in ((1, 3.841459), (3, 7.814728), (5, 11.070498)):
        assert abs(quality.chi2_quantile(0.95, dof) - found) < 1e-5


def test_limit_is_wider_for_few_documents():
    assert abs(quality.distance_limit(10**6) - quality.chi2_quantile(quality.CONFIDENCE, 4)) < 0.01
    # scipy.stats.f.ppf is not at hand: the limit for 54 documents, put into the F tail by numeric integration.
    import numpy as np

    f = quality.distance_limit(54) / (4 * (54**2 - 1) / (54 * 50))
    x = np.linspace(0, f, 400_001)
    density = (4 / 50) ** 2 * 25 * 26 * x * (1 + 4 * x / 50) ** -27.0
    assert abs(1 - np.trapezoid(density, x) - (1 - quality.CONFIDENCE)) < 1e-7


def test_empty_table(texts_frame):
    assert quality.judge(texts_frame(["x"]).limit(0)).count() == 0
