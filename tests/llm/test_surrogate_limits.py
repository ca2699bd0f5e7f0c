"""Surrogates on hostile and long texts, names without a title, and account numbers."""

import random
import re
import time

from motecraft.llm import surrogates


def replaced(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in sorted(surrogates.replace(docs).collect())]


def test_hostile_texts_take_linear_time(spark):
    texts = ["a@b" + ".b" * 20000, "語" * 200_000, "語" * 200_000 + "@", "a." * 100_000, "x" * 100_000 + "@mail.com", "=" * 50_000, "1" * 100_000, "+1 " * 50_000, "Mr. " * 50_000]
    replaced(spark, ["a@b.c"])
    start = time.time()
    got = replaced(spark, texts)
    assert time.time() - start < 60
    assert got[1:4] == texts[1:4] and got[5:7] == texts[5:7] and "@b.b" not in got[0] and "@mail.com" not in got[4]


def test_names_without_a_title_follow(spark):
    text = "Mr. John Smith met Anna. Later Smith said John Smith left; Smithers and johnson stayed, Smith's too. Dr. Mary Jones saw Jones."
    (got,) = replaced(spark, [text])
    m = re.fullmatch(r"Mr\. (\S+) (\w+) met Anna\. Later (\w+) said (\S+) (\w+) left; Smithers and johnson stayed, (\w+)'s too\. Dr\. (\S+) (\w+) saw (\w+)\.", got)
    assert m and m[1] == m[4] and m[2] == m[3] == m[5] == m[6] and m[8] == m[9]
    assert not re.search(r"\b(John|Smith|Mary|Jones)\b", got)
    (other,) = replaced(spark, ["Smith and Jones, John and Mary"])
    assert other == "Smith and Jones, John and Mary"


def test_a_name_that_is_given_and_family(spark):
    (got,) = replaced(spark, ["Mr. James Smith and Mrs. Ann James and Ms. James Lee saw James."])
    assert "James" not in got and got.split()[-1][:-1] == got.split(" and ")[1].split()[2]


def test_account_numbers_stay_valid(spark):
    rng = random.Random(31)

    def left(iban):
        moved = (iban[4:] + iban[:4]).replace(" ", "")
        return int("".join(str(int(c, 36)) for c in moved)) % 97

    ibans = []
    for country, n in (("DE", 18), ("GB", 18), ("FR", 23), ("ES", 20)):
        body = "".join(rng.choices("0123456789", k=n))
        body = "WEST" + body[4:] if country == "GB" else body
        iban = f"{country}{98 - left(country + '00' + body):02d}{body}"
        ibans += [iban, " ".join(iban[i : i + 4] for i in range(0, len(iban), 4))]
    assert all(left(i) == 1 for i in ibans)
    got = replaced(spark, [f"account {i}." for i in ibans])
    for old, new in zip(ibans, got, strict=True):
        new = new.removeprefix("account ").removesuffix(".")
        assert new != old and new[:2] == old[:2] and left(new) == 1 and re.sub("[0-9]", "0", new) != "" and [c == " " for c in new] == [c == " " for c in old]
    assert got[0].replace(" ", "") == got[1].replace(" ", "")
