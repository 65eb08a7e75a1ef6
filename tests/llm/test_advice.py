def test_variable_fields_alone_are_no_template(spark):
    from skipscan.llm import linededup

    rows = [(i, f"{i}1 {i}2 {i}3 {i}4\nrow {i}5 of table\n" + " ".join(f"{i}{j}" for j in range(14))) for i in range(4)]
    got = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].text == rows[0][1]
    assert all(got[i].n_dropped == 1 and got[i].text.split("\n") == rows[i][1].split("\n")[::2] for i in (1, 2, 3))


def test_values_before_other_digits_and_capitals():
    from skipscan.llm import pii

    p = pii.Permuter(b"k")
    for said, kinds, kept in (
        ("4111 1111 1111 1111 12/27", {"card": 1}, " 12/27"), ("4111111111111111 12 items", {"card": 1}, " 12 items"), ("12 4111111111111111 7", {"card": 1}, " 7"),
        ("1234 4111 1111 1111 1111 x", {"card": 1}, " x"), ("DE89 3704 0044 0532 0130 00 BIC COBADEFF", {"iban": 1}, " BIC COBADEFF"), ("DE89 3704 0044 0532 0130 00 OK", {"iban": 1}, " OK"),
        ("2021-05-03T10:00", {"date": 1}, "T10:00"), ("on 3.5.2021 or 2021-5-13.", {"date": 2}, "."),
    ):
        made, counts = pii.replaced(said, p)
        assert counts == kinds and made != said and made.endswith(kept) and len(made) == len(said) and pii.replaced(made, p, True)[0] == said
    assert pii.replaced("1234 5678 9012 3456 12 and 2021-5-3x", p) == ("1234 5678 9012 3456 12 and 2021-5-3x", {})


def test_a_licence_within_another():
    from skipscan.llm import licences

    found = lambda text, *own: [s[:3] for s in licences.Scanner([*licences.TEMPLATES, *own], licences.PHRASES, licences.SEED, licences.COVER).spans(licences.words(text.encode()))]
    for after in (". The source is here", " (the \"License\").", ""):
        assert found("Licensed under the Apache License, Version 2.0" + after) == [("apache-2.0", 0, 7)]
    assert found("k l m n o p q", ("long", "i j k l m n o p q r s t u v w"), ("short", "l m n o p")) == [("short", 1, 5)]
    # a stray run of the template's end does not keep the rest from its chain
    assert found("a1 b1 c1 d1 x9 e1 f1 g1 h1 i1 j1 k1", ("t", "a1 b1 c1 d1 e1 f1 g1 h1 i1 j1 k1 e1 f1 g1")) == [("t", 0, 11)]
