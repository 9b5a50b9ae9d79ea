"""Twenty-five lines that the tables lack: other licences and versions, prose with the words of licences, known wordings."""

import pytest

from ledgerspark.llm import license
from tests.conftest import SMALL

KNOWN = {
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "This code is released under the MIT License.": "MIT",
    "GNU General Public License version 3": "GPL-3.0",
    "Mozilla Public License 2.0": "MPL-2.0",
    "Eclipse Public License 2.0": "EPL-2.0",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
    "Alle Rechte vorbehalten.": "Proprietary",
}
OTHER = [
    "Eclipse Public License 1.0", "Apache License 1.1", "GNU General Public License version 2", "GNU Affero General Public License v3", "MPL 1.1", "CC BY 3.0", "EUPL v1.1", "Unlicense", "Public domain.",
    "Licencia publica general", "ISC License", "zlib License", "Boost Software License", "WTFPL", "Artistic License 2.0", "BSD 2-Clause License",
]
PROSE = ["All rights of the people were reserved for later.", "The commons of the village were creative with their terms."]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    lines = [*KNOWN, *OTHER, *PROSE]
    texts = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    return {lines[r["doc_id"]]: r for r in license.scan(texts, license.train(docs)).where("unit = 'line'").collect()}


def test_known_wordings_are_found(found):
    assert {line: found[line]["family"] for line in KNOWN} == KNOWN


def test_other_licences_and_versions_are_unknown_and_never_silent(found):
    assert {line: found[line]["family"] if line in found else None for line in OTHER} == dict.fromkeys(OTHER, license.UNKNOWN)


def test_nothing_is_confirmed_by_mistake(found):
    assert not [line for line in [*OTHER, *PROSE] if line in found and found[line]["confirmed"]]


def test_versions_and_runs(spark):
    rows = spark.createDataFrame([("Apache License, Version 2.0", "Apache-2.0"), ("Apache License 1.1", "Apache-2.0"), ("GPLv2 or GPLv3", "GPL-3.0"), ("MIT License 7", "MIT"), ("Mozilla, page 12", "MPL-2.0"), ("BSD 2-Clause", "BSD-3-Clause")], "line string, family string")
    got = [r[0] for r in rows.select(license.other_version(rows["line"], rows["family"])).collect()]
    assert got == [False, True, False, False, False, True]
    said = spark.createDataFrame([(" all rights of the people were reserved ",), (" copyright all rights reserved x ",)], "said string")
    assert [r[0] for r in said.select(license.stands_together(said["said"], ["all", "rights", "reserved"])).collect()] == [False, True]
