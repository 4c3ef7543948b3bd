"""The way from leads to originals against a plain loop over the same recorded responses."""

import random

from quillspark.operators import resolution

TITLE = "关于某项目的采购公告"
GOOD = f"<html><body><h1>{TITLE}</h1><p>本项目采用公开招标方式采购，欢迎符合条件的供应商按照公告要求参加。</p></body></html>"
FOUND = "lead_identity string, lead_url string, official_url string, official_host string, source_key string, kind string, transport_upgraded boolean, original_url string, method string"
ORDER = ("intention_project", "intention_group", "official_notice")


def group_page(link):
    return f"<html><body><table><tr><td>别的</td><td><a href='/x'>看</a></td></tr><tr><td>{TITLE}</td><td><a href='{link}'>看</a></td></tr></table></body></html>"


def plain(leads, found, responses):
    """What a loop does: candidates in order, twenty at most, until one passes."""
    edges = []
    for lead, url in leads:
        own = sorted((f for f in found if f[0] == lead and f[5] in ORDER), key=lambda f: (ORDER.index(f[5]), f[2]))[:20]
        if not own or " " in url:
            edges.append((lead, 0, 0, "", "unresolved", False))
            continue
        for n, f in enumerate(own, 1):
            asked, step, answer = f[2], 0, responses.get(f[2])
            if f[5] == "intention_group" and answer and answer[0] == 200:
                if answer[2] is None:
                    edges.append((lead, n, 0, asked, "official_group_unresolved", False))
                    continue
                edges.append((lead, n, 0, asked, "official_group_intermediate", False))
                asked, step = answer[2], 1
                if "gov.test" not in asked:
                    edges.append((lead, n, 1, asked, "official_group_unresolved", False))
                    continue
                step, answer = 2, responses.get(asked)
            passed = bool(answer and answer[0] == 200 and answer[1] == GOOD)
            edges.append((lead, n, step, asked, "official_original" if passed else "discovered_official_candidate", passed))
            if passed:
                break
    return edges


def test_against_a_plain_loop(spark):
    r = random.Random(5)
    leads = [(f"l{n}", "https://lead.test/a b" if n == 3 else f"https://lead.test/{n}") for n in range(12)]
    found, responses = [], {}
    for lead, url in leads:
        for n in range(r.choice([0, 1, 2, 3, 25]) if lead != "l0" else 25):
            kind = "official_notice" if lead == "l0" else r.choice(["official_notice"] * 3 + ["intention_group", "official_attachment"])
            address = f"https://www.gov.test/{lead}/{n}"
            found.append((lead, url, address, "www.gov.test", "gov", kind, False, "", "link"))
            if kind == "intention_group":
                project = r.choice([None, f"https://www.gov.test/{lead}/p{n}", "https://elsewhere.test/p"])
                responses[address] = r.choice([(200, group_page(project) if project else "<html><body><p>nothing here</p></body></html>", project), (404, "", None)])
                if project and r.random() < 0.7:
                    responses[project] = (200, r.choice([GOOD, "<html><body>another page, which is about other things</body></html>"]), None)
            elif r.random() < 0.8 and lead != "l0":
                responses[address] = r.choice([(200, GOOD, None), (500, GOOD, None), (200, "<html><body>another page, which is about other things</body></html>", None)])
    registry = spark.createDataFrame([("gov.test", False, "official", "gov")], "domain string, exact_only boolean, role string, key string")
    rows = spark.createDataFrame([(a, b, TITLE, "", "", "采购公告") for a, b in leads], "lead_identity string, lead_url string, title string, buyer string, code string, document_kind string")
    answers = spark.createDataFrame([(u, u, s, "text/html; charset=utf-8", page.encode(), "") for u, (s, page, _) in responses.items()], "requested_url string, final_url string, status int, content_type string, body binary, error string")
    edges = resolution.resolution(rows, spark.createDataFrame(found, FOUND), answers, registry, ("www.gov.test",))
    got = sorted((e.lead_identity, e.attempt, e.step, e.official_url, e.relation, e.verified) for e in edges.collect())
    want = sorted(plain(leads, found, responses))
    assert got == want
    assert max(n for _, n, *_ in got) == 20 and {e[4] for e in got} == {"unresolved", "official_original", "discovered_official_candidate", "official_group_intermediate", "official_group_unresolved"}


def test_no_leads(spark):
    registry = spark.createDataFrame([], "domain string, exact_only boolean, role string, key string")
    rows = spark.createDataFrame([], "lead_identity string, lead_url string, title string, buyer string, code string, document_kind string")
    answers = spark.createDataFrame([], "requested_url string, final_url string, status int, content_type string, body binary, error string")
    assert resolution.resolution(rows, spark.createDataFrame([], FOUND), answers, registry, ("www.gov.test",)).count() == 0
