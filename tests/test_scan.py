import random

import pytest

from fragloom import schema
from fragloom.operators import scan
from fragloom.operators.xmltokens import Lines, XmlError, tokens


def file_of(body: str, nikaya: str) -> str:
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<TEI.2>\n<text>\n<body>\n<p rend="nikaya">{nikaya}</p>\n{body}\n</body>\n</text>\n</TEI.2>\n'


def division(id_: str, kind: str, *inside: str) -> str:
    return f'<div id="{id_}" type="{kind}">\n' + "\n".join(inside) + "\n</div>"


def head(rend: str, text: str) -> str:
    return f'<head rend="{rend}">{text}</head>'


def para(rend: str, text: str, n: int | None = None) -> str:
    return f'<p rend="{rend}"' + (f' n="{n}"' if n else "") + f">{text}</p>"


DIGHA = file_of(division("dn1", "book", head("book", "Kitāb"), division("dn1_1", "sutta", head("chapter", "1. Ekasuttaṃ"), para("subhead", "Kathā"), para("bodytext", "ka kha ga", 1))), "Dīghanikāyo")
MAJJHIMA = file_of(division("mn1", "book", head("book", "Kitāb"), division("mn1_5", "vagga", head("chapter", "5. Pañcavaggo"), para("subhead", "1. Dvesuttaṃ"), para("bodytext", "ca cha", 439))), "Majjhimanikāyo")
SAMYUTTA = file_of(
    division(
        "sn1", "book", head("book", "Kitāb"),
        division(
            "sn1_1", "samyutta", head("chapter", "1. Paṭhamasaṃyuttaṃ"), para("title", "8. Aṭṭhavaggo"),
            para("subhead", "10. Dasasuttaṃ"), para("hangnum", '<hi rend="paranum">80</hi>', 80), para("gatha1", "ṭa ṭha"),
            para("subhead", "11. Ekādasasuttaṃ"), para("gatha1", "ta tha"), para("bodytext", "na –"),
        ),
        division("sn1_2", "samyutta", head("chapter", "2. Dutiyasaṃyuttaṃ"), para("title", "1. Ekavaggo"), para("subhead", "1. Kasuttaṃ"), para("bodytext", "pa pha", 82)),
    ),
    "Saṃyuttanikāyo",
)
ANGUTTARA = file_of(
    division("an3", "book", head("book", "Kitāb"), division("an3_1", "pannasaka", head("title", "1. Apaṇṇāsakaṃ"), division("an3_1_1", "vagga", head("chapter", "1. Khavaggo"), para("subhead", "1. Gasuttaṃ"), para("bodytext", "ya ra", 1)))),
    "Aṅguttaranikāyo",
)


def sections(rows):
    return [(r["cst_code"], r["cst_vagga"], r["cst_sutta"], r["cst_paranum"]) for r in rows if r["frag_type"] == "Sutta"]


@pytest.mark.parametrize(
    ("text", "nikaya", "file", "expected"),
    [
        (DIGHA, "digha", "s0101m.mul.xml", [("dn1.1", None, "1. Ekasuttaṃ", "1")]),
        (MAJJHIMA, "majjhima", "s0201m.mul.xml", [("mn1.5.1", "5. Pañcavaggo", "1. Dvesuttaṃ", "439")]),
        (ANGUTTARA, "anguttara", "s0402m2.mul.xml", [("an3.1.1.1", "1. Khavaggo", "1. Gasuttaṃ", "1")]),
        (
            SAMYUTTA,
            "samyutta",
            "s0301m.mul.xml",
            [
                ("sn1.1.8.10", "8. Aṭṭhavaggo", "10. Dasasuttaṃ", None),
                ("sn1.1.8.11", "8. Aṭṭhavaggo", "11. Ekādasasuttaṃ", None),
                ("sn1.2.1.1", "1. Ekavaggo", "1. Kasuttaṃ", "82"),
            ],
        ),
    ],
)
def test_codes_and_titles(text, nikaya, file, expected):
    rows = scan.segment(text, nikaya, file)
    assert sections(rows) == expected
    check_chain(text, rows)


def check_chain(text, rows):
    raw, lines = text.encode(), Lines(text.encode())
    assert "".join(r["content_xml"] for r in rows) == text
    assert rows[0]["frag_type"] == rows[-1]["frag_type"] == "Header"
    place = (1, 0)
    for r in rows:
        assert (r["start_line"], r["start_char"]) == place
        place = (r["end_line"], r["end_char"])
        assert raw[lines.byte(r["start_line"], r["start_char"]) : lines.byte(*place)].decode() == r["content_xml"]


def test_group_of_a_section_is_not_that_of_the_next():
    rows = scan.segment(SAMYUTTA, "samyutta", "s0301m.mul.xml")
    ids = [next((x["id"] for x in r["group_levels"] if x["group_type"] == "Samyutta"), None) for r in rows if r["frag_type"] == "Sutta"]
    assert ids == ["sn1_1", "sn1_1", "sn1_2"]


def test_deferred_groups_of_a_commentary():
    def group(k, subs):
        return f'<div id="sn1_{k}" type="samyutta">\n<head rend="chapter">{k}. Group{k}saṃyuttaṃ</head>\n<p rend="title">1. Paṭhamavaggo</p>\n{subs}\n</div>'

    sub = lambda k: f'<p rend="subhead">{k}. Name{k}suttavaṇṇanā</p>\n<p rend="bodytext" n="{k}">text</p>'
    text = file_of('<div id="sn1" type="book">\n<head rend="book">Book</head>\n' + group(1, sub(1) + "\n" + sub(2)) + group(2, '<p rend="bodytext">no subhead</p>') + group(3, sub(1)) + "\n</div>", "Saṃyuttanikāye")
    rows = scan.segment(text, "samyutta", "s0301a.att.xml")
    check_chain(text, rows)
    assert [c for c, *_ in sections(rows)] == ["sn1.1.1.1", "sn1.1.1.2", "sn1.2.1.2", "sn1.3.1.1"]
    assert len(sections(rows)) == 4
    third = [r for r in rows if r["frag_type"] == "Sutta"][2]
    assert "Group2" in third["content_xml"] and "Group3" not in third["content_xml"]


def test_anguttara_commentary_and_vaggas_without_sections():
    text = file_of(
        '<div id="an2" type="book">\n<head rend="book">Dukanipāta</head>\n<div id="an2_1" type="pannasaka">\n<head rend="title">1. Paṭhamapaṇṇāsakaṃ</head>\n'
        '<p rend="chapter">1. Kammakaraṇavaggo</p>\n<p rend="subhead">1. Vajjasuttavaṇṇanā</p>\n<p rend="bodytext" n="1">a</p>\n'
        '<p rend="subhead">2. Padhānasuttavaṇṇanā</p>\n<p rend="bodytext" n="2">b</p>\n'
        '<p rend="chapter">2. Adhikaraṇavaggavaṇṇanā</p>\n<p rend="bodytext" n="11">c</p>\n'
        '<p rend="chapter">3. Bālavaggavaṇṇanā</p>\n<p rend="bodytext" n="22">d</p>\n</div>\n</div>',
        "Aṅguttaranikāye",
    )
    rows = scan.segment(text, "anguttara", "s0402a.att.xml")
    check_chain(text, rows)
    assert [c for c, *_ in sections(rows)] == ["an2.1.1.1", "an2.1.1.2", "an2.1.2.0", "an2.1.3.0"]
    assert all(r["content_xml"].count('rend="chapter"') <= 1 for r in rows)


def test_digha_commentary_starts_at_the_division():
    text = file_of('<div id="dn1" type="book">\n<head rend="book">B</head>\n' + "".join(f'<div id="dn1_{k}" type="sutta">\n<head rend="chapter">{k}. N{k}suttavaṇṇanā</head>\n<p rend="bodytext" n="{k}">x</p>\n</div>\n' for k in (1, 2)) + "</div>", "Dīghanikāye")
    rows = scan.segment(text, "digha", "s0101a.att.xml")
    check_chain(text, rows)
    assert [c for c, *_ in sections(rows)] == ["dn1.1", "dn1.2"]
    assert rows[2]["content_xml"].startswith('<div id="dn1_2"')


def test_overrides_move_collapse_and_stop():
    rows = scan.segment(SAMYUTTA, "samyutta", "s0301m.mul.xml")
    first = rows[1]
    moved = scan.segment(SAMYUTTA, "samyutta", "s0301m.mul.xml", {"1.0": {"end_line": first["end_line"] - 1, "end_char": 0}})
    check_chain(SAMYUTTA, moved)
    assert moved[2]["start_line"] == first["end_line"] - 1
    collapsed = scan.segment(SAMYUTTA, "samyutta", "s0301m.mul.xml", {"2.0": {"collapse": True}})
    check_chain(SAMYUTTA, collapsed)
    assert collapsed[2]["content_xml"] == "" and len(collapsed) == len(rows)
    with pytest.raises(scan.CriticalError):
        scan.segment(SAMYUTTA, "samyutta", "s0301m.mul.xml", {"2.0": {"end_line": 1, "end_char": 0}})


def test_inserted_rows_shorten_and_move_on():
    rows = scan.segment(SAMYUTTA, "samyutta", "s0301m.mul.xml")
    line = rows[1]["end_line"] - 1
    new = scan.segment(SAMYUTTA, "samyutta", "s0301m.mul.xml", {}, [{"frag_idx_code": "1.1", "start_line": line, "start_char": 0, "end_line": rows[1]["end_line"], "end_char": rows[1]["end_char"]}])
    assert (new[1]["end_line"], new[1]["end_char"]) == (line, 0)
    assert (new[2]["start_line"], new[2]["start_char"]) == (rows[1]["end_line"], rows[1]["end_char"])


def test_random_files_keep_every_byte():
    rng = random.Random(5)
    pieces = ['<p rend="subhead">%d. Axyz</p>', '<p rend="title">%d. Bvaggo</p>', '<p rend="bodytext" n="%d">ṃ &amp; x</p>', '<p rend="chapter">%d. C</p>', "\n", " \n", "<pb ed='M' n='1'/>", "<!-- c -->", '<head rend="chapter">%d. D</head>']
    for _ in range(300):
        nikaya = rng.choice(list(schema.LEVELS))
        out = ['<div id="b1" type="book"><head rend="book">B</head>']
        for k in range(rng.randrange(6)):
            kind = rng.choice(["samyutta", "vagga", "sutta", "pannasaka"])
            out.append(f'<div id="b1_{k}" type="{kind}">' + "".join(p % rng.randrange(20) if "%" in p else p for p in rng.choices(pieces, k=rng.randrange(8))) + "</div>" + rng.choice(["", "\n", "  "]))
        text = file_of("".join(out) + "</div>", nikaya)
        file = rng.choice(["a.mul.xml", "a.att.xml", "a.tik.xml"])
        rows = scan.segment(text, nikaya, file)
        check_chain(text, rows)
        assert [r["frag_idx_code"] for r in rows] == [f"{i}.0" for i in range(len(rows))]


def test_tokenizer_covers_and_refuses():
    raw = '<a x="1>2" y=\'b\'>t &lt;<b/><!-- <x> --><![CDATA[<y>]]></a>'.encode()
    found = list(tokens(raw))
    assert b"".join(raw[t.start : t.end] for t in found) == raw
    assert found[0].attrs == {"x": "1>2", "y": "b"}
    for bad in (b"<a></b>", b"</a>", b"<a"):
        with pytest.raises(XmlError):
            list(tokens(bad))


def test_leading_numbers():
    cases = {"5-7.Title": "5-7", "1 Title": None, "1. Title": "1", "10.X": "10", "2-11. Y": "2-11", "Title": None, "-. X": None, ".": None}
    assert {k: scan.leading_number(k) for k in cases} == cases
