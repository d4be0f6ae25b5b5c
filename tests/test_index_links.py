"""Links of site index files against a plain reading with urljoin."""

import os
import re
from collections import Counter
from urllib.parse import urljoin

import pytest

from docweir.catalog.sites import derived, llms_links
from docweir.operators import site_index

SF = "/root/testdata/sf0.001"


def plain(files):
    out = Counter()
    for r in files.collect():
        for pos, line in enumerate(re.split("\r\n|\r|\n", r.body)):
            hit = re.match(site_index.LINK, line.strip())
            if hit:
                out[r.file_id, pos, hit[2] if re.match("https?://", hit[2]) else urljoin(r.url, hit[2])] += 1
    return out


def got(links):
    return Counter((r.file_id, r.pos, r.url) for r in links.collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
def test_registered_query_keeps_every_link(spark):
    want = plain(derived(spark, SF, "index_files"))
    assert any(".." in url for _, _, url in want) and got(llms_links(spark, SF)) == want


def test_dot_segments(spark):
    hrefs = ["../a.md", "./b.md", "c/../d.md", "../../../e.md", "/docs/Data..md", "/x/./y", "/x/../y.md", "..", "https://h.org/a/../b", "//o.org/z", "?q", "g.md#s"]
    files = spark.createDataFrame([(1, "https://h.org/docs/v/llms.txt", "\n".join(f"- [t]({h})" for h in hrefs))], "file_id long, url string, body string")
    assert got(site_index.links(files)) == plain(files) and len(plain(files)) == len(hrefs)
