"""Toxicity grammar: paths of the automaton, terms learnt from labels, held-out labels, odd rows."""

import random
import zlib

import pyarrow as pa

from acct_health.llm.toxicity import NEGATED, REPORTED, TARGETED, THREAT, Grammar, fit, matches, predict, scored

GRAMMAR = Grammar({"fool": 3.0, "nast*": 2.0}, {}, 0.02)


def _match(text):
    return matches(pa.array([text]), GRAMMAR)[0]


def test_paths():
    assert _match("nothing here") == [] and _match("") == []
    assert _match("A fool.") == [(3.0, (False, False, False))]
    assert _match('"Fool!"') == [(3.0, (False, False, False))]
    assert _match("you utter FOOL!!") == [(3.0, (True, False, False))]
    assert _match("you are not a fool") == [(3.0, (True, True, False))]
    assert _match("she said fool")[0][1] == (True, False, True)
    assert _match("no. fool") == [(3.0, (False, False, False))]  # another clause
    assert _match("not one of all these many words fool")[0][1] == (False, False, False)  # too far away
    assert _match("a nastier nast tone")[0] == (2.0, (False, False, False)) and len(_match("a nastier nast tone")) == 1
    assert _match("I will kill you, fool") == [(THREAT, (True, False, False)), (3.0, (True, False, False))]


def test_scores():
    plain, negated = GRAMMAR.score(_match("a fool")), GRAMMAR.score(_match("not a fool"))
    assert GRAMMAR.score([]) == 0.02 < negated < plain < GRAMMAR.score(_match("you fool"))
    assert GRAMMAR.path_weight((True, True, True)) == TARGETED + NEGATED + REPORTED
    assert GRAMMAR.score(_match("a fool and a nastier one")) == plain  # the strongest match alone


def _rows():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(700):
        text = rng.choices(words, k=rng.choice([8, 40, 200]))
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["zilch", "Zork,", "grumpax", "grumpol", "grumpet"]))
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    # a toxic text with many copies: its words are no terms
    docs += [(1000 + i, "copied harmless words all over") for i in range(60)]
    labels += [(1000 + i, 1) for i in range(60)]
    docs += [(2000, None), (2001, ""), (None, "zilch"), (2002, "you zilch"), (2002, "harmless words"), (2003, "w1 " * 30_000 + "grumpzzz")]
    labels += [(None, 1), (2000, None), (2002, 1), (2002, 0), (9999, 1)]
    return docs, labels


def _frames(spark, docs, labels):
    return (spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as score", "1 as predicted", "2 as toxic"),
            spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_held_out_labels(spark):
    docs, labels = _rows()
    grammar = fit(*_frames(spark, docs, labels))
    assert {"zilch", "zork", "grum*"} <= set(grammar.terms) and not {"copied", "harmless"} & set(grammar.terms)
    got = scored(*_frames(spark, docs, labels)).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    by_id = {r.doc_id: r for r in got}
    truth = dict(labels[:700])
    held = [(by_id[i].predicted, truth[i]) for i in range(700) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(by_id[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(700))
    assert len(held) > 100 and all(p == t for p, t in held)
    assert [by_id[i].predicted for i in (2000, 2001, 2003, None)] == [0, 0, 1, 1]
    assert sorted(r.predicted for r in got if r.doc_id == 2002) == [0, 1]


def test_held_out_labels_teach_nothing(spark):
    docs, labels = _rows()
    flipped = [(i, 1 - t if i is not None and t is not None and zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels]
    assert fit(*_frames(spark, docs, labels)) == fit(*_frames(spark, docs, flipped))


def test_no_labels_and_no_rows(spark):
    docs, _ = _rows()
    frame, labels = _frames(spark, docs, [(0, 0)])
    assert fit(frame, labels) == Grammar() and fit(frame.where("false"), labels.where("false")) == Grammar()
    assert {r.predicted for r in scored(frame, labels).collect()} == {0}
    assert scored(frame.where("false"), labels).count() == 0
    assert predict(frame, Grammar(), ["text", "toxic"]).columns == ["text", "toxic", "score", "predicted"]


def _predicted(spark, grammar, texts):
    got = predict(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), grammar, ["i"]).orderBy("i").collect()
    return [r.predicted for r in got]


def test_clean_negated_reported_and_lone_words(spark):
    strong = Grammar({"fool": 9.0, "nast*": 2.0})
    clean = ["kill", "kill time on a train", "stab", "you are not a fool", "no fool, you see", "she said fool", "she said you are a fool",
             'he laughed: "you fool" was in a letter', 'the word "fool" is old', "she said that I will kill you", "I will not kill you"]
    assert _predicted(spark, strong, clean) == [0] * len(clean)
    toxic = ["you fool", '"Fool!"', "I will kill you", "kill" + " w" * 40 + " you", 'a "small" word, you fool', "not now. you fool",
             "you are not a fool. you nastier fool"]
    assert _predicted(spark, strong, toxic) == [1] * len(toxic)


def test_whole_clause_is_read():
    assert _match("you" + " w" * 40 + " fool")[0][1] == (True, False, False)
    assert _match("word said" + " w" * 40 + " fool")[0][1] == (False, False, True)
    assert _match("she said. w fool")[0][1] == (False, False, False)


def test_threats_and_negated_matches_follow_the_labels(spark):
    docs, labels = _rows()
    more = [(3000 + i, f"du siehst w{i} stab am w{i + 7}", 0) for i in range(60)]
    more += [(4000 + i, f"w{i} you must strangle w{i + 3}", 1) for i in range(60)]
    more += [(5000 + i, f"w{i} w{i + 2} nicht zilch w{i + 5}", 1) for i in range(60)]
    ask = ["du siehst einen stab", "you I shall strangle", "I shall shoot you", "nicht zilch", "said zilch"]
    plain = fit(*_frames(spark, docs, labels))
    assert _predicted(spark, plain, ask) == [1, 1, 1, 0, 0]
    taught = fit(*_frames(spark, docs + [r[:2] for r in more], labels + [(i, t) for i, _, t in more]))
    assert taught.threats["stab"] < 0 < THREAT < taught.threats["strangle"] and "strangle" not in taught.terms
    assert _predicted(spark, taught, ask) == [0, 1, 1, 1, 0]
