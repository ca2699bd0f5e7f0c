"""Names of many shapes and scripts, dialling codes, and addresses of version six."""

import re
import unicodedata

from motecraft.llm import surrogates


def replaced(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in sorted(surrogates.replace(docs).collect())]


def script(c):
    return unicodedata.name(c).split()[0]


def test_names_with_hyphens_apostrophes_and_inner_capitals(spark):
    texts = [
        "Mr. Jean-Pierre Dupont came. Dupont left, and Jean-Pierre too; Dupont's hat stayed, so did the Dupont-Martin house.",
        "Mr. McDonald, Mrs. O'Brien and Ms  Anna   de la Cruz met; O'Brien spoke to Cruz about McDonald's.",
        "MR. JOHN SMITH wrote. SMITH and Smith are one, Mr. John Smith.",
        "Dr. Mary Ann Jones spoke to Jones, then Ann and Mary sang. Mr. J. R. Ewing left.",
        "MS Windows and DR Kongo stay.",
    ]
    a, b, c, d, e = replaced(spark, texts)
    assert not re.search("Jean|Pierre|Dupont", a) and a.startswith("Mr. ") and "'s hat" in a and "-Martin house" in a
    family = re.match(r"Mr\. \S+ (\w+) came\. (\w+) left", a)
    assert family and family[1] == family[2] and f"the {family[1]}-Martin" in a
    assert not re.search("McDonald|O'Brien|Cruz|Anna", b) and re.match(r"Mr\. \S+, Mrs\. \S+ and Ms  \w+   de la \w+ met; ", b)
    m = re.fullmatch(r"MR\. ([A-Z-]+) ([A-Z]+) wrote\. ([A-Z]+) and (\w+) are one, Mr\. ([\w-]+) (\w+)\.", c)
    assert m and m[2] == m[3] == m[4].upper() == m[6].upper() and m[1] == m[5].upper() and "SMITH" not in c
    m = re.fullmatch(r"Dr\. ([\w-]+) ([\w-]+) (\w+) spoke to (\w+), then ([\w-]+) and ([\w-]+) sang\. Mr\. J\. R\. (\w+) left\.", d)
    assert m and m[3] == m[4] and m[2] == m[5] and m[1] == m[6] and m[7] != "Ewing" and not re.search("Mary|Ann|Jones", d)
    assert e == texts[4]


def test_scripts_are_kept(spark):
    mail = ["γιώργος@παράδειγμα.ελ", "Иван@почта.рф", "李明@例子.公司", "かな@メール.jp", "դավիթ@փոստ.հայ", "שלום@דואר.il"]
    got = replaced(spark, ["Mr. Γιώργος Παπαδόπουλος met Frau Ελένη Μαρίνη.", "Mr. Դավիթ Սարգսյան left.", "Г-жа Анна Петрова ушла."] + mail)
    for name, text in zip(("GREEK", "ARMENIAN", "CYRILLIC"), got, strict=False):
        words = re.findall(r"(?:Mr\.|Frau|Г-жа) ([\w-]+) (\w+)", text)
        assert words and all(script(c) == name for pair in words for w in pair for c in w if c.isalpha())
    assert not re.search("Γιώργος Π|Μαρίνη|Սարգսյան|Петрова", " ".join(got[:3]))
    for old, new in zip(mail, got[3:], strict=True):
        assert new != old and new.endswith(".example")
        before, after = (re.match("[^@]*", x)[0] for x in (old, new))
        assert [script(c) for c in before] == [script(c) for c in after] and before.lower() != after


def test_dialling_codes_stay(spark):
    numbers = {"+44 20 7946 0958": "+44 ", "+1 415 555 2671": "+1 ", "+7 495 123 45 67": "+7 ", "+49 30 1234 5678": "+49 ", "+353 1 234 5678": "+353 "}
    got = replaced(spark, [f"call {n}!" for n in numbers])
    for (old, code), new in zip(numbers.items(), got, strict=True):
        new = new.removeprefix("call ").removesuffix("!")
        assert new != old and new.startswith(code) and re.sub(r"\d", "0", new) == re.sub(r"\d", "0", old)


def test_addresses_of_version_six(spark):
    old = ["2001:0db8:85a3:0000:0000:8a2e:0370:7334", "2001:db8::1", "fe80::1ff:fe23:4567:890a", "2001:DB8::1"]
    got = replaced(spark, [f"from {a}." for a in old] + ["at 12:30:45 std::dec, a::b and add::abc stay"])
    new = [t.removeprefix("from ").removesuffix(".") for t in got[:4]]
    assert got[4].endswith("stay") and got[4].startswith("at 12:30:45 std::dec, a::b and add::abc")
    assert all(re.sub("[0-9a-f]", "0", n) == re.sub("[0-9a-f]", "0", o.lower()) and n != o.lower() for n, o in zip(new, old, strict=True)) and new[1] == new[3]


def test_long_runs_of_names_need_no_stack(spark):
    texts = ["Mr. A" + "-b" * 50_000, "Mr. " + "A" * 100_000, "Mr. Ab" + "'C" * 50_000, "Mr. " + "Ab " * 50_000, "2001:" * 30_000, "::" * 50_000, "MR. " * 20_000]
    got = replaced(spark, texts)
    assert [len(g) > 0 for g in got] == [True] * len(texts)
