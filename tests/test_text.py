import random
import re

from pyspark.sql import functions as F

from parley.functions import text as tx

EMAIL, PHONE, ADDRESS = (re.compile(tx.EMAIL_PATTERN, re.I), re.compile(tx.PHONE_PATTERN), re.compile(tx.ADDRESS_PATTERN, re.I))


def _redacted(t):
    for pattern, token in ((EMAIL, tx.EMAIL_TOKEN), (PHONE, tx.PHONE_TOKEN), (ADDRESS, tx.ADDRESS_TOKEN)):
        t = pattern.sub(token, t)
    return t

TRICKY = ["a\r\nb\rc", "x\t\t y\x0b\x0cz\xa0\xa0w", "\x1c a \x85", "　 wide 　", "é 123 4567",
          "٣٤٥-٦٧٨٩", "+1 415-555-1234", "call 415-\n555-1234 now",
          "mail aſb@exKample.com or x.y@z.org", "12 North Main Street", "7 Oak ſt", "!!!", "???",
          "smile \U0001F600 sun ☀ check ✔", "(415) 555-1234", "İstanbul 5 Road Rd"]


def _random_strings(n, seed=7):
    rnd = random.Random(seed)
    alphabet = (list("abcXYZ019 .-_+@()%'") + ["́", "٣", "१", "\xa0", " ", "　",
                "ſ", "K", "İ", "ı", "\t", "\n", "\x1c", "é", "ß", "Δ"])
    words = ["St", "street", "Ave", "road", "Blvd", "north", "main", "com", "org", "mail"]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rnd.randint(1, 12)):
            r = rnd.random()
            if r < 0.3:
                parts.append(rnd.choice(words))
            elif r < 0.5:
                parts.append("".join(rnd.choice("0123456789") for _ in range(rnd.randint(1, 7))))
            else:
                parts.append("".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 6))))
        out.append(rnd.choice([" ", "", "-", "@", "."]).join(parts))
    return out


def test_redaction_parity_with_python_re(spark):
    texts = TRICKY + _random_strings(3000)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", tx.redact_email("t").alias("e"), tx.redact_phone("t").alias("p"),
                    tx.redact_address("t").alias("a"), tx.redact("t").alias("all")).collect()
    changed = 0
    for r in got:
        t = texts[r["i"]]
        assert r["e"] == EMAIL.sub(tx.EMAIL_TOKEN, t), t
        assert r["p"] == PHONE.sub(tx.PHONE_TOKEN, t), t
        assert r["a"] == ADDRESS.sub(tx.ADDRESS_TOKEN, t), t
        assert r["all"] == _redacted(t), t
        changed += r["all"] != t
    assert changed > 100


def test_redaction_on_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for r in d.select("text", tx.redact("text").alias("red")).collect():
        assert r["red"] == _redacted(r["text"])


def test_redact_types():
    assert tx.redact_kinds(None) == ["email", "phone", "address"]
    assert tx.redact_kinds(["Emails", "tel"]) == ["email", "phone"]
    assert tx.redact_kinds(["bogus", " "]) == ["email", "phone", "address"]
    assert tx.redact_kinds(["addr"]) == ["address"]


def test_normalisers_golden(spark):
    cases = [  # text, newlines, collapsed, message line, clean line
        ("p\r\nq\rr", "p\nq\nr", "p\nq\nr", "p q r", "p q r"),
        (" m \t\x0b n \n\n o ", " m \t\x0b n \n\n o ", "m n\n\no", "m n o", "m n o"),
        ("u\xa0\xa0v", "u\xa0\xa0v", "u\xa0\xa0v", "u\xa0\xa0v", "u v"),
        ("\x1c w \x85", "\x1c w \x85", "w", "w", "w"),
        ("", "", "", "", "")]
    df = spark.createDataFrame([(c[0],) for c in cases], "t string")
    got = df.select("t", tx.normalize_newlines("t"), tx.collapse_whitespace(tx.normalize_newlines("t")),
                    tx.normalize_message_line("t"), tx.clean_line("t")).collect()
    assert [tuple(r) for r in got] == cases
    emoji = spark.createDataFrame([("sun \u2600\u2601 face \U0001F600!",), ("\U0001F2FF \U0001FB00",)], "t string")
    assert [r[0] for r in emoji.select(tx.strip_emoji("t")).collect()] == ["sun  face !", "\U0001F2FF \U0001FB00"]


def test_normaliser_properties(spark):
    df = spark.createDataFrame([(t,) for t in TRICKY + _random_strings(500, seed=3)], "t string")
    once = df.select("t", tx.normalize_newlines("t").alias("b1"), tx.strip_emoji("t").alias("b3"), tx.normalize_text("t", True, True).alias("b4"),
                     tx.normalize_message_line("t").alias("b5"), tx.clean_line("t").alias("b6"), tx.strip_ws("t").alias("s"))
    twice = once.select("*", tx.normalize_newlines("b1").alias("c1"), tx.strip_emoji("b3").alias("c3"), tx.normalize_text("b4", True, True).alias("c4"),
                        tx.normalize_message_line("b5").alias("c5"), tx.clean_line("b6").alias("c6"))
    for r in twice.collect():
        assert "\r" not in r["b1"] and r["s"] == r["t"].strip()
        assert "\n" not in r["b5"] and r["b5"] == r["b5"].strip() and "  " not in r["b5"]
        assert r["b6"].split() == r["t"].split() and r["b6"] == " ".join(r["b6"].split())
        for k in "13456":
            assert r["b" + k] == r["c" + k]      # doing it again changes nothing
        # nothing but white space and emoji goes
        assert "".join(r["b5"].split()) == "".join(r["t"].split())


def test_inline_metadata(spark):
    cases = [("[3/4/22, 7:15 AM] Ingrid: good morning", ("good morning", "Ingrid", "3/4/22, 7:15 AM")), ("good morning", ("good morning", None, None)),
             ("[now]  Olaf :   see you ", ("see you", "Olaf", "now")), ("[z] " + "q" * 81 + ": too long", ("[z] " + "q" * 81 + ": too long", None, None)),
             ("[k] l: ", ("", "l", "k")), ("  [w]\tUna:\tword  ", ("word", "Una", "w")), ("[] x: y", ("[] x: y", None, None))]
    df = spark.createDataFrame([(t,) for t, _ in cases], "t string")
    got = [tuple(r["m"][k] for k in ("msg", "speaker", "timestamp")) for r in df.select(tx.inline_metadata("t").alias("m")).collect()]
    assert got == [want for _, want in cases]


def test_clean_for_embedding(spark):
    df = spark.createDataFrame([("[t1] A: one\nplain\n[t3] C: three",), ("[t1] A: solo",)], "t string")
    r = df.select(tx.clean_for_embedding("t").alias("c")).collect()
    assert r[0]["c"]["text"] == "one\nplain\nthree"
    assert (r[0]["c"]["speaker"], r[0]["c"]["timestamp"]) == ("A", "t1")
    assert (r[0]["c"]["start_speaker"], r[0]["c"]["end_speaker"]) == ("A", "C")
    assert (r[0]["c"]["start_timestamp"], r[0]["c"]["end_timestamp"]) == ("t1", "t3")
    assert r[1]["c"]["start_speaker"] is None and r[1]["c"]["speaker"] == "A"


def test_answers_and_stops(spark):
    cases = [  # text, answer, without role prefix
        ("You: morning all", "morning all", "morning all"), ("USER:   yes", "yes", "yes"), ("later user: and", "later", "later user: and"),
        ("ok you: no", "ok", "ok you: no"), ("two\nlines", "two lines", "two\nlines"), ("  ", "", ""),
        ("p you: q user: r", "p you: q", "p you: q user: r"), ("user:you: s", "you: s", "you: s"), ("you:", "", ""), ("noyou: t", "noyou: t", "noyou: t")]
    df = spark.createDataFrame([(c[0],) for c in cases], "t string")
    assert [tuple(r) for r in df.select("t", tx.clean_answer("t"), tx.strip_role_prefix("t")).collect()] == cases
    df2 = spark.createDataFrame([("USER: x\nYOU: hello\nUSER: more",)], "t string")
    cut = df2.select(tx.truncate_at_stops("t", 15, ["\nUSER:", "\n"]).alias("c")).first()["c"]
    assert cut == "USER: x\nYOU: hello"
    p = spark.createDataFrame([("x" * 150,), ("a\nb",)], "t string").select(tx.preview("t").alias("p")).collect()
    assert p[0]["p"] == "x" * 137 + "..." and p[1]["p"] == "a b"


def test_metadata_prefix(spark):
    df = spark.createDataFrame([("2024-01-01", "Ann"), (" ", "Bob"), ("d", " ")], "d string, n string")
    got = [r[0] for r in df.select(tx.metadata_prefix("d", "n")).collect()]
    assert got == ["[2024-01-01] Ann: ", "Bob: ", "[d] "]


def test_clean_for_embedding_properties(spark):
    rnd = random.Random(17)
    line = lambda: rnd.choice(["[t1] Ann: hi", "[t2]  Bo b:x: y", "plain", " [t3] " + "n" * 85 + ": no", "[] z: no", "[t4] C: ", "é", ""])
    texts = ["\n".join(line() for _ in range(rnd.randint(1, 4))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", tx.clean_for_embedding("t").alias("c")).collect():
        c, lines = r["c"], texts[r["i"]].split("\n")
        said = [(x, "t1", "Ann") if x == "[t1] Ann: hi" else (x, "t2", "Bo b") if x.startswith("[t2]") else (x, "t4", "C") if x.startswith("[t4]")
                else (x, None, None) for x in lines]
        speakers = {s for _, _, s in said if s}
        assert "[t1]" not in c["text"] and "[t2]" not in c["text"]
        assert (c["speaker"] is None or c["speaker"] in speakers) and (c["start_speaker"] is None or c["start_speaker"] in speakers)
        if not speakers:
            assert all(c[k] is None for k in ("speaker", "timestamp", "start_speaker", "end_speaker"))


def test_stops_and_preview_random(spark):
    rnd = random.Random(23)
    alphabet = ["a", "b", " ", "\n", "USER:", "YOU:", "you:", " user:", ".", "é", "\r\n", "\t"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    texts += ["x" * n for n in (139, 140, 141, 200)]
    stops = ["\n", "\nUSER:", "\nYOU:", "b."]
    df = spark.createDataFrame([(i, t, rnd.randint(0, 10)) for i, t in enumerate(texts)], "i int, t string, s int")
    got = df.select("i", "s", tx.truncate_at_stops("t", F.col("s"), stops).alias("cut"),
                    tx.preview("t").alias("p")).collect()
    for r in got:
        t, start = texts[r["i"]], r["s"]
        hits = [j for j in (t.find(x, start) for x in stops) if j != -1]
        assert r["cut"] == (t[:min(hits)] if hits else t)
        p = t.replace("\n", " ").strip()
        assert r["p"] == (p[:137] + "..." if len(p) > 140 else p)
