"""Every report that is given as SQL against plain Python over the collected relations: the meaning, not the engine."""

from collections import Counter, defaultdict
from datetime import datetime, timedelta
from pathlib import Path

import pytest

from fieldloom.operators.relational import AS_OF
from fieldloom.plans.catalog import QUERIES
from fieldloom.sources.relations import Relations

HERE = Path("/root/testdata/sf0.001")
NOW = datetime.fromisoformat(AS_OF)
KEY = ("document_id", "field_name")


class Data:
    def __init__(self, spark):
        r = Relations(spark, str(HERE))
        for name in ("templates", "documents", "facts", "feedback", "attempts", "patterns", "jobs"):
            setattr(self, name, [x.asDict() for x in getattr(r, name).collect()])
        self.lines = [x.asDict() for x in r.lines.select("l_orderkey", "p_brand").collect()]
        self.doc = {d["document_id"]: d for d in self.documents}
        self.fact = {key(f): f for f in self.facts}
        self.fb = dict(groups(self.feedback, lambda f: f["document_id"]))
        self.confident = {f["document_id"] for f in self.facts if f["confidence"] >= 0.3}
        self.fbkey = {key(f): f for f in self.feedback}


@pytest.fixture(scope="module")
def data(spark):
    if not HERE.exists():
        pytest.skip("no test tables")
    return Data(spark)


def key(x):
    return tuple(x[k] for k in KEY)


def pick(rows, *names):
    return [tuple(r[n] for n in names) for r in rows]


def groups(rows, by):
    out = defaultdict(list)
    for r in rows:
        out[by(r)].append(r)
    return out


def mean(values):
    values = list(values)
    return sum(values) / len(values)


def first(rows, order, n=1):
    return sorted(rows, key=order)[:n]


def later(x):
    return -x.timestamp() if x.tzinfo else -(x - datetime(1970, 1, 1)).total_seconds()


def template(d, f):
    return d.doc[f["document_id"]]["template_id"]


def newest_completed(d, kind):
    out = {}
    for j in d.jobs:
        if j["status"] == "completed" and j["type"] == kind:
            out[j["template_id"]] = max(out.get(j["template_id"], j["created_at"]), j["created_at"])
    return out


def s13(d):
    for config, ps in groups(d.patterns, lambda p: p["field_config"]).items():
        best = sorted((p for p in ps if p["is_active"]), key=lambda p: (-p["priority"], -p["frequency"], p["pattern_id"]))
        names = [p["pattern"] for p in best[:2]] + [None, None]
        yield config, len(ps), names[0], names[1], len(best)


def r02(d):
    for (t, f), rows in groups(d.feedback, lambda f: (template(d, f), f["field_name"])).items():
        unused = sum(not x["used"] for x in rows)
        yield t, f, "none" if unused < 5 else "full" if len(rows) % 20 < unused else "incremental"


def r04(d):
    per = groups(d.jobs, lambda j: (j["template_id"], j["field_id"]))
    for k, rows in per.items():
        last = max(rows, key=lambda j: (j["created_at"], j["job_id"]))
        failed = sum(j["status"] == "failed" for j in rows)
        if failed and last["status"] not in ("pending", "running"):
            yield *k, failed


def k02(d):
    for f in d.feedback:
        yield (*key(f), f["corrected_value"] + "!", False) if f["feedback_id"] % 3 == 0 else (*key(f), f["corrected_value"], True)


def k03(d):
    for (t, s, f), rows in groups([a for a in d.attempts if a["success"]], lambda a: (template(d, a), a["strategy"], a["field_name"])).items():
        right = sum(a["value"] == d.fact[key(a)]["truth"] for a in rows)
        yield t, s, f, len(rows), right, right / len(rows)


def k13(d):
    for config, ps in groups(d.patterns, lambda p: p["field_config"]).items():
        ids = sorted(p["pattern_id"] for p in ps)
        yield from ((i, config, v, i == ids[-1]) for v, i in enumerate(ids, 1))


def p15(d):
    for p in d.patterns:
        hit = p["pattern_id"] % 2 == 0
        rate = (p["success_count"] + hit) / (p["usage_count"] + 1)
        yield p["pattern_id"], rate, (0.2 if rate >= 0.9 else 0.1 if rate >= 0.7 else 0.0) if hit else -0.1 if rate < 0.3 else p["boost"]


def p20(d):
    acc = {k: mean(a["value"] == d.fact[key(a)]["truth"] for a in rows) for k, rows in groups([a for a in d.attempts if a["success"]], lambda a: (a["field_name"], a["strategy"])).items()}
    for f in {f for f, _ in acc}:
        top = max(v for (g, _), v in acc.items() if g == f)
        if top < 0.5:
            yield f, top


def t04(d):
    c = {k: mean(f["confidence"] for f in rows) for k, rows in groups(d.facts, lambda f: (f["method"], f["field_name"])).items()}
    for m in {m for m, _ in c}:
        own = [(f, round(v, 9)) for (k, f), v in c.items() if k == m]
        top = [f for f, _ in sorted(own, key=lambda x: (-x[1], x[0]))]
        low = [f for f, _ in sorted(own, key=lambda x: (x[1], x[0]))]
        yield from ((m, f, top.index(f) + 1, low.index(f) + 1) for f, _ in own if top.index(f) < 3 or low.index(f) < 3)


def u06(d):
    fb = Counter(template(d, f) for f in d.feedback)
    pseudo = Counter(template(d, f) for f in d.facts if f["confidence"] >= 0.8 and f["document_id"] not in d.fb)
    yield from ((t, "feedback", n) for t, n in fb.items())
    yield from ((t, "pseudo", min(n, max(0, 2200 - fb[t]))) for t, n in pseudo.items() if min(n, 2200 - fb[t]) > 0)


def j05(d):
    homes = {(x["p_brand"], d.doc[x["l_orderkey"]]["template_id"]) for x in d.lines}
    names = {t["template_id"]: t["name"] for t in d.templates}
    return [(p["pattern_id"], p["field_config"], t, names[t]) for p in d.patterns if p["is_active"] for brand, t in homes if brand == p["field_config"]]


def j06(d):
    for t in d.templates:
        docs = [x for x in d.documents if x["template_id"] == t["template_id"] and x["status"] == "validated"]
        used = [f for x in docs for f in d.fb.get(x["document_id"], []) if f["used"]]
        yield t["template_id"], t["name"], len(docs), len({f["document_id"] for f in used}), len(used)


def j08(d):
    for x in d.documents:
        last = max(d.fb.get(x["document_id"], []), key=lambda f: f["feedback_id"], default=None)
        yield x["document_id"], last and last["feedback_id"], last and last["field_name"]


def j09(d):
    per = groups(d.facts, lambda f: f["document_id"])
    for x in d.documents:
        best = min(per.get(x["document_id"], []), key=lambda f: (-f["confidence"], f["position"]), default=None)
        yield x["document_id"], best and best["field_name"], best and best["confidence"]


def j10(d):
    done = newest_completed(d, "purchase")
    since = datetime(2000, 1, 1)
    return Counter(t for f in d.feedback if not f["used"] for t in [template(d, f)] if f["created_at"] > done.get(t, since)).items()


def j11(d):
    done = {}
    for f in d.feedback:
        if f["used"]:
            done[f["field_name"]] = max(done.get(f["field_name"], f["created_at"]), f["created_at"])
    n = Counter(f["field_name"] for f in d.feedback if not f["used"] and f["created_at"] > done.get(f["field_name"], datetime(2000, 1, 1)))
    return [(f, k) for f, k in n.items() if k >= 5]


def j26(d):
    train = {}
    for f in d.facts:
        if f["document_id"] % 5 and f["value"]:
            v = f["value"].strip().lower()
            train[v] = min(train.get(v, f["document_id"]), f["document_id"])
    return [(*key(f), train[v]) for f in d.facts if f["document_id"] % 5 == 0 for v in [f["value"].strip().lower()] if v in train]


def j28(d):
    t = groups([x for x in d.documents if x["phase"]], lambda x: (x["template_id"], x["phase"]))
    for i in {i for i, _ in t}:
        b, a = t.get((i, "baseline")), t.get((i, "adaptive"))
        if a and b:
            yield i, len(b), len(a), mean(x["extraction_time_ms"] for x in a) - mean(x["extraction_time_ms"] for x in b)



WANT = {
    "j01_feedback_of_template": lambda d: [(f["feedback_id"], 1, f["field_name"]) for f in d.feedback if template(d, f) == 1],
    "j02_documents_with_template": lambda d: [(x["document_id"], x["template_name"]) for x in d.documents],
    "j03_documents_without_feedback": lambda d: [(x["document_id"], x["status"]) for x in d.documents if x["document_id"] not in d.fb],
    "j04_validated_without_field_feedback": lambda d: [(x["document_id"],) for x in d.documents if x["status"] == "validated" and not any(f["field_name"] == "field_1" for f in d.fb.get(x["document_id"], []))],
    "j05_pattern_star": j05,
    "j06_active_star": j06,
    "j07_pattern_performance": lambda d: [(p["pattern_id"], p["field_config"], round(100 * p["success_count"] / p["usage_count"], 2) if p["usage_count"] else 0.0) for p in d.patterns if p["is_active"]],
    "j08_latest_feedback": j08,
    "j09_top_one_per_document": j09,
    "j10_newer_than_last_job": j10,
    "j11_fields_to_learn": j11,
    "j12_latest_by_subquery": lambda d: [(x["document_id"], t, x["status"]) for t, rows in groups(d.documents, lambda x: x["template_id"]).items() for x in [max(rows, key=lambda x: x["document_id"])]],
    "j13_nested_in": lambda d: [(f, n) for f, n in Counter(f["field_name"] for f in d.feedback).items() if f in {x["field_name"] for x in d.facts if template(d, x) == 2 and d.doc[x["document_id"]]["status"] == "validated"}],
    "j14_typical_length": lambda d: [(*k, int(mean(len(f["corrected_value"]) for f in rows))) for k, rows in groups(d.feedback, lambda f: (template(d, f), f["field_name"])).items() if len(rows) >= 5],
    "j15_feedback_counts": lambda d: [(x["document_id"], len(d.fb.get(x["document_id"], []))) for x in d.documents],
    "j16_fields_with_feedback": lambda d: [(*key(f), f["method"]) for f in d.facts if key(f) in d.fbkey],
    "j17_extracted_and_true": lambda d: [(*k, d.fact[k]["value"] if k in d.fact else "", d.fbkey[k]["corrected_value"] if k in d.fbkey else "") for k in {*d.fact, *d.fbkey}],
    "j18_overlay": lambda d: [(*k, d.fbkey[k]["corrected_value"] if k in d.fbkey else d.fact[k]["value"]) for k in {*d.fact, *d.fbkey}],
    "j26_exact_leakage": j26,
    "j28_phase_join": j28,
    "p01_phase_filter": lambda d: [("production", sum(x["phase"] is None for x in d.documents)), ("all", len(d.documents)), ("baseline", sum(x["phase"] == "baseline" for x in d.documents))],
    "p02_visibility": lambda d: [(x["document_id"], x["template_id"]) for x in d.documents if x["created_by"] == 7],
    "p03_validated_unused": lambda d: [(x["document_id"],) for x in d.documents if x["status"] == "validated" and any(not f["used"] for f in d.fb.get(x["document_id"], []))],
    "p05_substring_search": lambda d: Counter(p["field_config"] for p in d.patterns if "steel" in p["pattern_type"].lower() or "e" in p["pattern"].lower()).items(),
    "p06_in_list": lambda d: [(f["feedback_id"], f["field_name"]) for f in d.feedback if template(d, f) == 5 and d.doc[f["document_id"]]["status"] == "pending"],
    "p15_usage_update": p15,
    "p16_success_rate": lambda d: [(p["pattern_id"], round(100 * p["success_count"] / p["usage_count"], 2) if p["usage_count"] else 0.0) for p in d.patterns],
    "p20_problematic_fields": p20,
    "p22_changed_only": lambda d: [(f["feedback_id"],) for f in d.feedback if key(f) in d.fact and f["original_value"].strip(" ") != f["corrected_value"].strip(" ")],
    "p24_low_performers": lambda d: [(p["pattern_id"], p["success_count"] / p["usage_count"]) for p in d.patterns if p["usage_count"] >= 10 and p["success_count"] / p["usage_count"] < 0.3 and p["is_active"]],
    "p26_stale_jobs": lambda d: [(j["job_id"], j["template_id"]) for j in d.jobs if j["status"] == "running" and j["created_at"] < NOW - timedelta(minutes=30)],
    "r05_job_timeouts": lambda d: [(j["job_id"], ("pending" if j["job_id"] % 3 < 2 else "failed") if j["created_at"] < NOW - timedelta(minutes=30) else "running") for j in d.jobs if j["status"] == "running"],
    "r02_field_trigger": r02,
    "r04_active_jobs": r04,
    "s13_template_configs": s13,
    "t01_recent_feedback": lambda d: pick(first(d.feedback, lambda f: (later(f["created_at"]), -f["feedback_id"]), 10), "feedback_id", *KEY),
    "t02_top_fields_by_error": lambda d: first(Counter(f["field_name"] for f in d.feedback if f["original_value"].strip(" ") != f["corrected_value"].strip(" ")).items(), lambda x: (-x[1], x[0]), 10),
    "t03_last_hundred": lambda d: pick(first(d.feedback, lambda f: (later(f["created_at"]), -f["feedback_id"]), 100), "feedback_id", "created_at"),
    "t04_top_and_bottom": t04,
    "t05_pattern_order": lambda d: pick(first([p for p in d.patterns if p["is_active"]], lambda p: (-p["priority"], -p["frequency"], p["pattern_id"]), 50), "pattern_id", "priority", "frequency"),
    "t06_suggestion_order": lambda d: [(t, p["pattern_id"], n) for t, rows in groups([p for p in d.patterns if p["is_active"]], lambda p: p["pattern_type"]).items() for n, p in enumerate(first(rows, lambda p: (-p["match_rate"], -p["frequency"], p["pattern_id"]), 5), 1)],
    "t07_worst_fields": lambda d: first([(f, round(mean(x["confidence"] for x in rows), 9)) for f, rows in groups(d.facts, lambda f: f["field_name"]).items()], lambda x: (x[1], x[0]), 5),
    "t08_largest_gains": lambda d: first([(i, sum(len(f["corrected_value"]) - len(f["original_value"]) for f in rows)) for i, rows in d.fb.items() if rows], lambda x: (-x[1], x[0]), 3),
    "t10_next_job": lambda d: [(t, min(rows, key=lambda j: (j["created_at"], j["job_id"]))["job_id"]) for t, rows in groups([j for j in d.jobs if j["status"] == "pending"], lambda j: j["template_id"]).items()],
    "t13_page": lambda d: pick(first([x for x in d.documents if x["template_id"] == 3], lambda x: (x["created_at"], x["document_id"]), 60)[40:], "document_id", "created_at"),
    "t14_multi_key_listing": lambda d: pick(first([p for p in d.patterns if p["frequency"] > 20], lambda p: (p["pattern_type"], -p["frequency"], -p["priority"], p["pattern_id"]), 30), "pattern_id", "pattern_type", "frequency", "priority"),
    "u01_union_all": lambda d: [(f["field_name"], f["corrected_value"], "corrected") for f in d.feedback] + [(f["field_name"], f["value"], "validated") for f in d.facts if template(d, f) == 1 and d.doc[f["document_id"]]["status"] == "validated"],
    "u02_key_union": lambda d: {*d.fact, *d.fbkey},
    "u03_not_corrected": lambda d: [key(f) for f in d.facts if f["document_id"] in d.fb and key(f) not in d.fbkey],
    "u05_distinct_values": lambda d: [(f, len({x["value"] for x in rows})) for f, rows in groups(d.facts, lambda f: f["field_name"]).items()],
    "u06_pseudo_labels": u06,
    "u07_training_union": lambda d: [(i, "feedback") for i in {f["document_id"] for f in d.feedback}] + [(x["document_id"], "validated") for x in d.documents if x["status"] == "validated" and x["document_id"] not in d.fb and x["document_id"] in d.confident],
    "k02_feedback_upsert": k02,
    "k03_strategy_counters": k03,
    "k05_statistic_merge": lambda d: [(*k, sum(p["frequency"] for p in rows), max(p["usage_count"] for p in rows), max(rows, key=lambda p: p["pattern_id"])["match_rate"]) for k, rows in groups(d.patterns, lambda p: (p["field_config"], p["pattern"])).items()],
    "k07_dead_letters": lambda d: pick([j for j in d.jobs if j["status"] == "failed"], "job_id", "template_id", "type", "payload", "created_at"),
    "k08_cascading_delete": lambda d: [("facts", sum(template(d, f) != 2 for f in d.facts)), ("feedback", sum(template(d, f) != 2 for f in d.feedback))],
    "k09_mark_used": lambda d: [(f["feedback_id"], f["used"] or template(d, f) == 4) for f in d.feedback],
    "k13_versions": k13,
    "a43_throughput": lambda d: [(p, 60000 / mean(x["extraction_time_ms"] for x in rows), max(x["extraction_time_ms"] for x in rows) / 60000) for p, rows in groups([x for x in d.documents if x["phase"] and x["extraction_time_ms"] > 0], lambda x: x["phase"]).items()],
}


def plain(v):
    if isinstance(v, datetime):
        return v.isoformat()
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    return round(float(v), 6)


@pytest.mark.parametrize("name", sorted(WANT))
def test_report_means_what_it_says(spark, data, name):
    got = Counter(tuple(map(plain, r)) for r in QUERIES[name](spark, str(HERE)).collect())
    want = Counter(tuple(map(plain, r)) for r in WANT[name](data))
    assert got == want
