import random

from logquarry.llm import licenses as L


def test_every_template_is_found():
    scanner = L.Scanner(L.Settings())
    rng = random.Random(1)
    for k, (name, template) in enumerate(L.TEMPLATES):
        words = ["".join(rng.choices("aeiounst", k=rng.randint(2, 9))) for _ in range(300)]
        text = " ".join(words[:150]) + ".\n" + template + "\n" + " ".join(words[150:])
        hits = scanner.scan(text)
        assert [h["license"] for h in hits] == [name], (k, hits)
        start = text.index(template)
        assert abs(hits[0]["start"] - start) <= 1 and abs(hits[0]["end"] - start - len(template)) <= 2


def test_wording():
    scanner = L.Scanner(L.Settings())
    hit = scanner.scan("This thing is licensed under the GNU General Public License, version 3.")[0]
    assert (hit["license"], hit["missing"], hit["added"]) == ("GPL-3.0", 1, 1)
    assert scanner.scan("They gave us permission to drive with a license in the public domain of the town.") == []
    assert [h["license"] for h in scanner.scan("Licensed%%% under### CC*** BY-NC&&& 4.0.$$$")] == ["CC-BY-NC-4.0"]
    assert len(scanner.scan("Released under the MIT License. " * 3)) == 3


def test_tables(odd, none, spark):
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(1, "Licensed under CC BY 4.0."), (1, "Licensed under CC BY 4.0.")], "doc_id long, text string"))
    assert [r["license"] for r in L.find_licenses(docs).collect()] == ["CC-BY-4.0"] * 2
    assert L.find_licenses(odd).count() == 0 and L.find_licenses(none).count() == 0


def test_whole_texts_and_near_relations():
    scanner = L.Scanner(L.Settings())
    names = lambda t: [h["license"] for h in scanner.scan(t)]
    texts = dict(L.TEMPLATES[: len(list(L._FOLDER.iterdir()))])
    for name in ("GPL-3.0", "LGPL-2.1", "Apache-2.0"):
        hit = scanner.scan("Some words. " * 5 + texts[name] + " more words" * 5)
        assert [h["license"] for h in hit] == [name] and hit[0]["end"] - hit[0]["start"] > 0.95 * len(texts[name])
    two = f"{L._BSD}\n{L._BSD_TWO}\n{L._AS_IS}"
    assert names("Copyright us.\n" + two) == ["BSD-2-Clause"]
    assert names(two.replace("COPYRIGHT HOLDERS", "REGENTS").replace(L._AS_IS[:9], f"{L._BSD_NAMES} THIS SOFT")) == ["BSD-3-Clause"]
    for kind, version, name in (("", "2", "GPL-2.0"), ("", "3", "GPL-3.0"), ("Lesser ", "2.1", "LGPL-2.1"), ("Lesser ", "3", "LGPL-3.0"), ("Affero ", "3", "AGPL-3.0")):
        for what in ("program", "library", "file"):
            assert names(L._NOTICE.format(what=what, mark=":", kind=kind, end=",", version=version)) == [name]
    assert names("Released under an MIT License.") == ["MIT"] and names("Licensed under the Artistic license.") == []
    assert names("# SPDX-License-Identifier: Apache-2.0 OR MIT\nimport os") == ["Apache-2.0 OR MIT"]
    assert names(L._ISC) == ["ISC"] and names(f"{L._MIT} {L._MIT_REST}") == ["MIT"]
