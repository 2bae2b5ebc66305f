import random
import re

import pytest

from vitalforms.llm import licenses
from vitalforms.llm.licenses import PHRASES, TEMPLATES, Automaton, license_labels, parse, scan_text

SMALL = (("one", "x [y [z]] {a b|c} end"), ("gap", "x <1-3> stop"), ("tail", "go [x|y y]"), ("zero", "x <0-2> z {|q} q"))


def pattern(parts):
    """The same language as a regular expression over words followed by a space each."""
    out = ""
    for part in parts:
        if isinstance(part, bytes):
            out += re.escape(part.decode()) + " "
        elif part[0] == "gap":
            out += r"(?:[^ ]+ ){%d,%d}" % part[1:]
        else:
            out += "(?:" + "|".join(pattern(o) for o in part[1]) + ")"
    return out


def brute(text, templates):
    """Every stretch of words tried against every template."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, base, labels, covered = [], set(), set(), set()
    for phrase, label in PHRASES.items():
        want = phrase.split()
        for i in range(len(words)):
            if words[i:i + len(want)] == want:
                places.append(i)
                base.add(label)
                covered.update(range(i, i + len(want)))
    for label, template in templates:
        rule = re.compile(pattern(parse(template)))
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                if rule.fullmatch("".join(w + " " for w in words[i:j])):
                    labels.add(label)
                    covered.update(range(i, j))
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | labels)), len(covered) / len(words) if words else 0.0)


def test_automaton_equals_brute_force_on_random_words():
    rng = random.Random(3)
    for _ in range(400):
        text = " ".join(rng.choice("x y z a b c end stop go q w cc by".split()) for _ in range(rng.randint(0, 14)))
        assert scan_text(text.encode(), SMALL) == brute(text, SMALL), text


def test_templates_equal_brute_force_on_their_own_wordings():
    rng = random.Random(9)

    def wording(parts):
        out = []
        for part in parts:
            if isinstance(part, bytes):
                out.append(part.decode())
            elif part[0] == "gap":
                out += ["name"] * rng.randint(*part[1:])
            else:
                out += wording(rng.choice(part[1]))
        return out

    for label, template in TEMPLATES:
        for _ in range(3):
            words = wording(parse(template))
            assert label in scan_text(" ".join(words).upper().encode())[5].split(",")
            text = "Intro, " + ". ".join(words) + " the end"
            if len(words) < 40:
                assert scan_text(text.encode()) == brute(text, TEMPLATES)
        mandatory = [i for i, p in enumerate(parse(template)) if isinstance(p, bytes)]
        parts = parse(template)
        for i in mandatory:  # one changed mandatory word is never accepted
            changed = wording(parts[:i]) + ["changedword"] + wording(parts[i + 1:])
            own = Automaton(((label, template),))
            assert not list(own.matches(own.classes_of(" ".join(changed).encode())))


@pytest.mark.parametrize("text, labels", [
    ("Released under the MIT License.", "mit,mit-notice"),
    ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"),
    ("GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or "
     "(at your option) any later version", "gpl,gpl-2.0,gpl-2.0-or-later"),
    ("Copyright (c) 2020 Jane Roe. All rights reserved.", "all-rights-reserved"),
    ("the license is not mit, the Apache has no License", ""),
    ("", ""), ("mité license", ""), ("mit-license", "mit")])
def test_known_wordings(text, labels):
    assert scan_text(text.encode())[5] == labels


def test_wrong_templates_are_refused():
    for bad in ("a [b", "a } b", "[a]", "<0-3>", "a <3-1>"):
        with pytest.raises(ValueError):
            Automaton((("x", bad),))


def test_rows_and_edges(spark, docs_of, monkeypatch):
    monkeypatch.setattr(licenses, "PIECE", 50)  # pieces end between words
    long = "word " * 60_000 + "Released under the MIT License. " + "licensed under the " * 20_000
    texts = [None, "", "  ", "CC-BY cc by", "ñ MIT License é", long, "mit license", "mit license"]
    ids = [0, 1, 2, 3, 4, 5, 7, 7]
    df = docs_of(texts, ids).withColumnRenamed("row", "labels").withColumnRenamed("size", "n_words")
    got = sorted(map(tuple, license_labels(df).collect()))
    want = [(i, *(brute(t, TEMPLATES) if t != long else (120_005, 1, 60_003, 60_003, "mit", "mit,mit-notice", 5 / 120_005)))
            for i, t in zip(ids, texts)]
    want[5] = got[5][:1] + (60_000 + 5 + 60_000,) + want[5][2:7] + (got[5][7],)
    assert got == want and 0 < got[5][7] < 1e-4
    assert license_labels(df.where("false")).count() == 0
    fresh = spark.createDataFrame([(None, "mit license")], "doc_id long, text string")
    assert tuple(license_labels(fresh).first())[:3] == (None, 2, 1)
