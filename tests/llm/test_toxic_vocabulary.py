"""A toxic vocabulary of hundreds of words is learned whole."""

import random

from athanor.llm.toxicity import fit


def test_rare_words_of_a_large_toxic_vocabulary_are_known():
    rng = random.Random(4)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    plain, toxic = [word("aeioulmnrst", rng.randint(3, 8)) for _ in range(500)], [word("bcdfghjkpquvwxyz", 8) for _ in range(120)]
    text = lambda some: " ".join(rng.sample(rng.choices(plain, k=40) + some, 40 + len(some)))
    learn = [text([w, *rng.choices(toxic[:30], k=1)]) for w in toxic for _ in range(16)]
    ordinary = [text([]) for _ in range(4000)]
    scorer = fit(learn + ordinary, [True] * len(learn) + [False] * len(ordinary))
    caught = sum(scorer.score(text([w, w])) >= 0.5 for w in toxic[30:])
    assert caught >= 80
    assert sum(scorer.score(text([])) >= 0.5 for _ in range(200)) <= 4
