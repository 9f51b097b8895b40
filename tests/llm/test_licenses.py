import re
import textwrap

from _texts import SCHEMA, corpus

from quillsieve.llm.licenses import TEMPLATES, scan_licenses, size_bounds


NOTICE = r"copyright[ \t]*(?:\(c\)|©|[0-9])"


def grams(text):
    low = re.sub(r"(?m)^" + NOTICE + r"[^\n]*$", "", "".join(c.lower() if c.isascii() else c for c in text))
    w = re.findall("[a-z0-9]+", low)
    return {(a, b) for a, b in zip(w, w[1:], strict=False)}


KNOWN = {g for texts in TEMPLATES.values() for t in texts for g in grams(t)}


def runs(text):
    """Lines up to one of other text."""
    out = [[]]
    for line in text.split("\n"):
        low = line.lower()
        w = [] if re.match(NOTICE, low) else re.findall("[a-z0-9]+", low)
        pairs = list(zip(w, w[1:], strict=False))
        if 2 * sum(p in KNOWN for p in pairs) < len(pairs):
            out.append([])
        else:
            out[-1].append(line)
    return ["\n".join(x) for x in out]


def brute(text, threshold=0.8):
    top = []
    for s in dict.fromkeys([text, *re.split(r"\n[ \t\r]*\n", text), *text.split("\n"), *runs(text)]) if text is not None else []:
        a = grams(s)
        m = [(-2 * len(a & b) / (len(a) + len(b)), name) for name, texts in TEMPLATES.items() for t in texts for b in [grams(t)] if a and 2 * len(a & b) / (len(a) + len(b)) >= threshold]
        if m:
            top.append(min(m))
    best = min(top, default=(0, None))
    return best[1], round(-best[0], 9), ",".join(sorted({x[1] for x in top}))


def wrapped(text, width=70):
    return "\n".join("# " + x for x in textwrap.wrap(text, width))


def test_licences_of_many_paragraphs_and_in_code(spark):
    full = {name: max(texts, key=len) for name, texts in TEMPLATES.items()}
    made = {}
    for k, (name, text) in enumerate(sorted(full.items())):
        half = text.find(". ", len(text) // 3) + 1 or len(text)
        paragraphs = f"{textwrap.fill(text[:half], 60)}\n\n{textwrap.fill(text[half:], 60)}"
        made[3 * k] = name, f"The Library\n\nCopyright (c) 2020 Some One\n\n{paragraphs}\n\nSome other things are told below in plain words.\n" * 2
        made[3 * k + 1] = name, f"import os\nfor x in os.listdir('folder'): print(x)\n{wrapped(text)}\nimport sys\nprint(sys.path, sys.argv)"
        few = min(TEMPLATES[name], key=len).split()
        made[3 * k + 2] = None, " ".join(few[: len(few) // 2]) + "\nnothing of the kind is said in this text of mine"
    out = scan_licenses(spark.createDataFrame([(k, t) for k, (_, t) in made.items()], "doc_id long, text string")).collect()
    assert {r.doc_id: r.license for r in out if r.doc_id % 3 < 2} == {k: v[0] for k, v in made.items() if k % 3 < 2}
    assert all(r.license is None for r in out if r.doc_id % 3 == 2)


def test_equals_brute_force(spark):
    mit, apache = TEMPLATES["MIT"], TEMPLATES["Apache-2.0"]
    more = [
        "words here\nLicensed under CC BY-NC 4.0.\nmore", "licensed under cc by nc 4 0", mit[1], f"Copyright (c) 2020 X\n\n{mit[1]}", f"head\n\n{apache[1]}\n\ntail\n{mit[0]}\n{mit[0]}",
        apache[1].replace("software", "program"), "Licensed under the Apache License", "License", "a\n\n\nb", "x y " * 5000, "Released under the MIT License. Released under the MIT License.",
    ]
    more += [f"int main();\n{wrapped(t)}\nreturn 0;" for texts in TEMPLATES.values() for t in texts]
    rows = [*corpus(seed=2, n=20), *[(2000 + k, t, "en", "s", 0) for k, t in enumerate(more)], (None, mit[0], "en", "s", 0), (2000, more[0], "en", "s", 0)]
    out = scan_licenses(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    got = sorted(((r.doc_id, (r.license, round(r.dice, 9), r.licenses)) for r in out), key=str)
    assert got == sorted(((r[0], brute(r[1])) for r in rows), key=str)


def test_bounds_and_empty(spark):
    for n in range(1, 60):
        low, high = size_bounds(n, 0.8)
        fit = [a for a in range(1, 200) if 2 * min(a, n) / (a + n) >= 0.8 - 1e-12]
        assert (low, high) == (fit[0], fit[-1])
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0
