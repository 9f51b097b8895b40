"""Small made-up texts with copies, near copies, shared passages and odd cases."""

import random

WORD = "alpha Beta gamma delta. Écho fox_trot golf hotel-7 india juliett kilo lima".split()


def corpus(n=60, seed=3, longest=90):
    rng = random.Random(seed)
    passage = " ".join(rng.choice(WORD) + str(rng.randint(0, 30)) for _ in range(34))
    texts = []
    for k in range(n):
        words = [rng.choice(WORD) + str(rng.randint(0, 40)) for _ in range(rng.randint(0, longest))]
        kind = rng.random()
        if texts and kind < 0.15:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.4:
            old = (rng.choice([t for t in texts if t] or ["x"])).split()
            for _ in range(rng.randint(0, 3)):
                if old:
                    old[rng.randrange(len(old))] = "edit" + str(rng.randint(0, 99))
            texts.append(rng.choice([" ", "\n", "\t "]).join(old))
        elif kind < 0.65:
            at = rng.randint(0, len(words))
            texts.append(" ".join([*words[:at], passage, *words[at:]]))
        else:
            texts.append(rng.choice([" ", "\r\n", "  "]).join(words))
    texts += [None, "", " \n\t", "one", "a a a a " * 30, "a " * 120, "ünï çödé " * 3, "\x0b\x0cx\x1cy z"]
    return [(k * 3 % 1009, t, "en", f"s{k % 3}", 0 if t is None else len(t)) for k, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
