import random

import corpus_pipeline as cp
from tests.llm.test_pipeline import ITEM, WORDS, corpus, write


def test_junk_in_letters_is_rejected_and_short_texts_stay(spark, tmp_path):
    rng = random.Random(53)
    mash = ["".join(rng.choice("bcdfghjklmnpqrstvwxyz") for _ in range(7)) for _ in range(60)]
    junk = [(1000 + i, " ".join(rng.choice(mash) for _ in range(n)), "en", "a") for i, n in enumerate((2, 3, 10, 40) * 5)]
    other = [(2000, "hyvää huomenta kuinka voit tänään", "en", "a"), (2001, "привет как дела", "de", "a")]
    short = [(3000 + i, " ".join(WORDS[lang][i : i + n]), lang, "a") for i in range(8) for n, lang in ((3, "en"), (2, "de"))]
    rows = corpus(rng) + short
    # the junk has no label: it is to be judged, not learned
    docs = write(spark, tmp_path, rows + [(i, t, None, s) for i, t, _, s in junk + other], [(1, ITEM)])
    got = {r.doc_id for r in cp.language_id(spark, docs, str(tmp_path)).collect()}
    assert got == {r[0] for r in rows} - {300, 301, 302}
