"""Evidence, clusters, votes, scores, rules, projection and whole runs."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from veridra.operators import cluster, confidence, match, merge, profile, rules
from veridra.plans import consolidate, projection, reports, validation
from veridra.schema import EVIDENCE, FIELDS
from veridra.sources import ats_json, github_api, manifest, recruiter_csv, resume_text

HEADER = "candidate_id,full_name,email,phone,location,headline,github,resume_file,company,job_title,skills,experience_years\n"
RESUME = """Ana Prova
ana@x.example | 415-555-2671 | github.com/anaprova | linkedin.com/in/ana
Senior engineer
Technical Skills
Python, C++, java
Work Experience
Acme - Builder Sep 2020 - Present
Built things
Led people
Beta | Tester
Education
X University - BSc
"""
SETTINGS = {
    "fields": [
        {"path": "full_name"},
        {"path": "primary_email", "from": "emails[0]", "required": True},
        {"path": "city", "from": "location.city"},
        {"path": "emails", "type": "array"},
        {"path": "skills", "type": "array"},
        {"path": "n_skills", "type": "number", "computed": "calculate_skills_count"},
        {"path": "experience", "type": "array"},
    ],
    "include_confidence": False,
    "include_provenance": False,
}


def text_value(value):
    return (value, None, None, None, None, None)


def evidence(spark, rows):
    """Rows of (candidate, profile_ord, item_ord, field, text, source, confidence[, norms])."""
    made = [(c, p, i, f, text_value(v), None, s, "m", conf, list(norms[0]) if norms else []) for c, p, i, f, v, s, conf, *norms in rows]
    return spark.createDataFrame(made, EVIDENCE)


def voted(spark, rows):
    ordered = merge.with_value(cluster.order(evidence(spark, rows)))
    return merge.vote(cluster.cluster(ordered))


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sources")
    (folder / "c.csv").write_text(
        HEADER
        + 'C1,ana  prova,ANA@X.example ,(415) 555-2671,"Lisbon, Lisboa, PT",Dev & lead,https://github.com/anaprova,r.pdf,acme,builder,Python|java||x,5\n'
        + 'C2,Bo Li,bo@y.example,98765-11111,"Pune, IN",,,,,,react,x\n'
        + "C1,dup,dup@x.example,,,,,,,,,\n"
        + 'C3,"Quo ""Q"" Te\nsted",,,Rome,,,,,tester,,0\n'
        + "C4,short\n"
    )
    (folder / "a.json").write_text(
        json.dumps(
            {
                "candidate_id": "C1",
                "name": "Ana Prova",
                "email": "ana@x.example",
                "location": {"city": "Lisbon", "country": "PT"},
                "experience_years": 6,
                "skills": ["python", " Go "],
                "experience": [{"company": "Acme", "title": "Builder", "start": "Sep 2020", "end": "Present"}, {"start": "x"}],
                "education": [{"institution": "x university", "degree": "bsc", "end_year": "2014"}, {"degree": "none"}],
            }
        )
    )
    (folder / "b.json").write_text(json.dumps({"id": "C9", "full_name": "No One"}))
    (folder / "d.json").write_text("{broken")
    resumes = spark.createDataFrame([("r.pdf", "Resume_PDF", RESUME), ("e.pdf", "Resume_PDF", "")], "resume_path string, kind string, text string")
    github = spark.createDataFrame(
        [("anaprova", "Nobody Else", "bio", "Porto", "https://github.com/anaprova", ["Python", "Go"])],
        "username string, name string, bio string, location string, html_url string, languages array<string>",
    )
    return consolidate.Sources(
        csv=recruiter_csv.read(spark, str(folder / "c.csv")),
        ats=ats_json.read(spark, [str(folder / f) for f in ("a.json", "b.json", "d.json")]),
        github=github,
        resumes=resumes,
    )


def stated(found, candidate, field):
    rows = found.filter((F.col("candidate_id") == candidate) & (F.col("field") == field)).orderBy("item_ord").collect()
    return [r["raw"] for r in rows]


def test_csv_scan(spark, sources):
    found = recruiter_csv.evidence(sources.csv).cache()
    assert [r["text"] for r in stated(found, "C1", "full_name")] == ["ana  prova"]
    assert [r["text"] for r in stated(found, "C1", "skills")] == ["Python", "java", "", "x"]
    assert stated(found, "C1", "location")[0]["location"].asDict() == {"city": "Lisbon", "region": "Lisboa", "country": "PT"}
    assert stated(found, "C2", "location")[0]["location"].asDict() == {"city": "Pune", "region": None, "country": "IN"}
    assert stated(found, "C3", "location")[0]["location"].asDict() == {"city": "Rome", "region": None, "country": None}
    assert stated(found, "C2", "years_experience") == []
    assert stated(found, "C3", "years_experience")[0]["number"] == 0.0
    assert stated(found, "C3", "full_name")[0]["text"] == 'Quo "Q" Te\nsted'
    assert stated(found, "C3", "experience")[0]["experience"]["company"] == ""
    assert stated(found, "C4", "full_name")[0]["text"] == "short"
    assert recruiter_csv.scan_upload(sources.csv).filter("name = 'short'").count() == 1


def test_ats_scan(spark, sources):
    objects = ats_json.for_candidates(sources.ats)
    found = ats_json.evidence(objects).cache()
    assert {r[0] for r in found.select("candidate_id").distinct().collect()} == {"C1", "C9"}
    assert [r["text"] for r in stated(found, "C1", "skills")] == ["python", "Go"]
    assert stated(found, "C1", "location")[0]["location"]["city"] == "Lisbon"
    assert stated(found, "C1", "years_experience")[0]["number"] == 6.0
    assert len(stated(found, "C1", "experience")) == 1
    assert stated(found, "C1", "education")[0]["education"]["institution"] == "x university"


@pytest.mark.parametrize(
    ("value", "field", "wanted"),
    [
        ({"experience_years": 0}, "years_experience", []),
        ({"experience_years": "0"}, "years_experience", [0.0]),
        ({"experience_years": "many"}, "years_experience", []),
        ({"skills": "a|b"}, "skills", ["a", "b"]),
        ({"full_name": None, "name": "N"}, "full_name", []),
        ({"name": "N"}, "full_name", ["N"]),
        ({"location": "Rome"}, "location", ["Rome"]),
    ],
)
def test_ats_edges(spark, value, field, wanted):
    files = spark.createDataFrame([("p", json.dumps({"id": "A"} | value))], "ats_path string, value string")
    found = stated(ats_json.evidence(ats_json.for_candidates(ats_json.parse(files))), "A", field)
    parts = [r["number"] if field == "years_experience" else r["location"]["city"] if field == "location" else r["text"] for r in found]
    assert parts == wanted


def test_ats_without_id_belongs_to_the_only_candidate(spark):
    files = spark.createDataFrame([("p", '{"name": "N"}')], "ats_path string, value string")
    one = spark.createDataFrame([("K",)], "candidate_id string")
    assert ats_json.for_candidates(ats_json.parse(files), one).first()["candidate_id"] == "K"


def test_recent_languages(spark):
    repos = [("u", lang, f"2024-01-{20 - i:02}") for i, lang in enumerate(["Go", None, "C", "Go"] + ["Rust"] * 10 + ["Ada", "Zig"])]
    found = github_api.recent_languages(spark.createDataFrame(repos, "username string, language string, updated_at string"))
    assert found.first()["languages"] == ["Go", "C", "Rust", "Ada"]


def test_docx_and_spaced_text(spark):
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w") as parts:
        parts.writestr("word/document.xml", '<w:d xmlns:w="u"><w:p><w:t>Ana</w:t><w:t>Dev</w:t></w:p></w:d>')
    assert resume_text.docx_text(content.getvalue()) == "Ana\nDev"
    assert resume_text.docx_text(b"no zip") == ""
    spaced = spark.createDataFrame([("A n a  P r o v a",), ("plain text",)], "t string")
    assert [r[0] for r in spaced.select(resume_text.respace(F.col("t"))).collect()] == ["Ana Prova", "plain text"]


def test_resume_rules(spark, sources):
    row = resume_text.parse(sources.resumes).collect()
    assert len(row) == 1
    row = row[0]
    assert row["name"] == "Ana Prova"
    assert row["emails"] == ["ana@x.example"]
    assert row["phones"] == ["415-555-2671"]
    assert row["headline"] == "Senior engineer"
    assert row["links"].asDict() == {"linkedin": "linkedin.com/in/ana", "github": "github.com/anaprova", "portfolio": None, "other": []}
    assert row["skills"] == ["python", "c", "java"]
    assert [(e["company"], e["title"], e["start"], e["summary"]) for e in row["experience"]] == [
        ("Acme", "Builder Sep 2020", "Sep 2020", "Built things\nLed people\nBeta | Tester")
    ]
    assert row["education"][0]["institution"] == "X University"


def test_sections():
    parts = resume_text.sections_of("Top\nSkills\na\nWORK EXPERIENCE\nb\nskills\nlast")
    assert {k: v.strip() for k, v in parts.items()} == {"header": "Top", "skills": "last", "experience": "b"}
    assert resume_text.sections_of("nothing here") == {"header": "nothing here"}


def test_email_and_skill_clusters(spark):
    rows = [("K", 0, i, "emails", v, "s", 0.9) for i, v in enumerate(["a@x.org", "A@x.org ", "b@x.org"])]
    rows += [("K", 1, i, "skills", v, "s", 0.9) for i, v in enumerate(["Python", "python", "Java"])]
    found = cluster.cluster(merge.with_value(cluster.order(evidence(spark, rows))))
    sizes = {(r["field"], r["n"]) for r in found.groupBy("field", "cluster").agg(F.count("*").alias("n")).collect()}
    assert sizes == {("emails", 2), ("emails", 1), ("skills", 2), ("skills", 1)}
    assert found.count() == len(rows)


def test_leader_clustering_depends_on_the_first_member(spark):
    rows = [("K", 0, i, "skills", v, "s", 0.8) for i, v in enumerate(["java", "javascript", "script"])]
    found = cluster.cluster(merge.with_value(cluster.order(evidence(spark, rows)))).orderBy("seq").collect()
    assert found[0]["cluster"] == found[1]["cluster"] != found[2]["cluster"]


def test_weighted_vote_and_rejection(spark):
    row = voted(spark, [("K", 0, 0, "full_name", "A", "s1", 0.9), ("K", 1, 0, "full_name", "B", "s2", 0.8)]).first()
    assert (row["value_key"], row["score"]) == ("A", 0.9)
    assert [r["value"] for r in row["provenance"]["rejected_sources"]] == ["B"]
    assert row["provenance"]["merge_decision"] == (
        "Selected value 'A' with aggregate confidence score 0.90 supported by 1 source(s) (s1). Rejected 1 conflicting evidence source(s)."
    )


def test_ties_go_to_the_later_value(spark):
    row = voted(spark, [("K", 0, 0, "headline", "A", "s1", 0.8), ("K", 1, 0, "headline", "B", "s2", 0.8)]).first()
    assert row["value_key"] == "B"


def test_agreement_and_penalties(spark):
    rows = [("A", p, 0, "emails", "a@x.org", f"s{p}", 0.8) for p in range(2)]
    rows += [("P", 0, 0, "phones", "+14155552671", "s", 0.9, ["E164_Format"]), ("Q", 0, 0, "phones", "x", "s", 0.9)]
    rows += [("F", 0, 0, "skills", "React", "s", 0.8, ["Fuzzy_Match_80pct", "Fuzzy_Match_90pct"])]
    rows += [("C", p, 0, "headline", v, f"s{p}", 0.8) for p, v in enumerate("abcdef")]
    scored = confidence.score(voted(spark, rows)).cache()
    found = {r["candidate_id"]: r["confidence"] for r in scored.collect()}
    assert found["A"] == 0.90  # 0.8 + 0.05 + 0.05
    assert found["P"] == 1.0
    assert found["Q"] == 0.6
    assert found["F"] == 0.79  # the last label counts
    assert found["C"] == 0.65  # no more than 0.15 off
    assert all(0 <= v <= 1 for v in found.values())
    overall = {r[0]: r[1] for r in confidence.overall(scored).collect()}
    assert overall["C"] == 0.70 and overall["Q"] == 0.6


def test_votes_do_not_depend_on_row_order(spark):
    rows = [("K", p, i, f, f"v{(p * i) % 3}", f"s{p}", 0.8 + p / 20) for p in range(3) for i in range(4) for f in ("headline", "emails")]
    one = voted(spark, rows).select("field", "cluster", "value_key", "score")
    other = voted(spark, rows[::-1]).select("field", "cluster", "value_key", "score")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))
    total = voted(spark, rows).select(F.sum(F.col("provenance.agreement_count") + F.size("provenance.rejected_sources"))).first()[0]
    assert total == len(rows)


def test_rules(spark):
    rows = [("K", 0, 0, "full_name", "A", "s", 0.4), ("K", 0, 1, "skills", "go", "s", 0.9), ("K", 0, 2, "skills", "Ada", "s", 0.9)]
    rows += [("K", 0, 3, "skills", "c", "s", 0.3)]
    scored = confidence.score(voted(spark, rows))
    profiles = profile.assemble(scored)
    wanted = {"min_field_confidence": 0.5, "skill_blacklist": [" GO "], "required_fields": ["emails", "skills", "full_name"]}
    row = rules.apply(profiles, wanted).first()
    assert row["full_name"] is None and [s["value"] for s in row["skills"]] == ["Ada"]
    assert row["missing_fields"] == ["emails", "full_name"] and row["rules_failed"]
    banned = spark.createDataFrame([("Go",)], "skill string")
    assert rules.drop_skills(scored, banned).filter("field = 'skills'").count() == 2


def test_run_of_all_candidates(spark, sources):
    run = consolidate.run(spark, sources, SETTINGS)
    profiles = {r["candidate_id"]: r for r in run.profiles.collect()}
    assert set(profiles) == {"C1", "C2", "C3", "C4"}
    ana = profiles["C1"]
    assert ana["full_name"]["value"] == "Ana Prova"
    assert ana["emails"][0]["provenance"]["agreement_count"] == 3
    assert {e["value"]["company"] for e in ana["experience"]} >= {"Acme"}
    assert ana["headline"]["value"] in ("Dev Lead", "Senior Engineer")
    payload = {r["candidate_id"]: json.loads(r["payload"]) for r in run.payloads().collect()}
    assert payload["C1"]["full_name"] == "Ana Prova" and payload["C1"]["primary_email"] == "ana@x.example"
    assert payload["C1"]["city"] == "Lisbon"
    assert payload["C3"]["primary_email"] is None and payload["C3"]["emails"] == []
    assert payload["C1"]["n_skills"] == len(ana["skills"])
    told = {r["candidate_id"]: r for r in run.validated.collect()}
    assert told["C1"]["is_valid"]
    assert told["C3"]["warnings"] == ["Required field 'primary_email' was missing and has been set to null."]
    report = {(r["candidate_id"], r["profile_ord"]): r["report"] for r in run.extraction_report().collect()}
    assert report["C2", 2]["skills"] == ["react"]


def test_run_of_one_candidate(spark, sources):
    auto = consolidate.run(spark, sources, SETTINGS, "AUTO").profiles.collect()
    assert [r["candidate_id"] for r in auto] == ["C1"]
    named = consolidate.run(spark, sources, SETTINGS, "C2").profiles.collect()
    assert [r["candidate_id"] for r in named] == ["C2"]
    sources_of = {s["source"] for s in named[0]["skills"][0].asDict()["provenance"].asDict()["rejected_sources"]}
    assert sources_of == set()


def test_github_matches_by_name(spark, sources):
    rows = sources.csv
    people = spark.createDataFrame([("zz", "Ana  Prova"), ("li", "X"), ("qq", "Nobody")], "username string, name string")
    found = {r["username"]: r["candidate_id"] for r in match.match_profiles(people, rows).collect()}
    assert found["li"] == "C2" and found["qq"] is None


def test_omit_and_error(spark, sources):
    settings = SETTINGS | {"on_missing": "omit"}
    payload = {r["candidate_id"]: json.loads(r["payload"]) for r in consolidate.run(spark, sources, settings).payloads().collect()}
    assert "primary_email" not in payload["C3"] and "emails" not in payload["C3"] and payload["C3"]["n_skills"] == 0
    with pytest.raises(Exception, match="Required field 'primary_email' is missing"):
        consolidate.run(spark, sources, SETTINGS | {"on_missing": "error"}).projected.collect()


def test_reprojection_options(spark, sources):
    run = consolidate.run(spark, sources, SETTINGS)
    fields = [{"path": p, "type": "array"} for p in ("phones", "skills", "experience", "education")] + [{"path": "location", "type": "object"}]
    options = {"phone_norm": "Raw", "skills_norm": "Original", "country_norm": "Full", "dates_norm": "DD/MM/YYYY"}
    plain = {"fields": fields, "include_confidence": False, "include_provenance": False} | options
    rows = {r["candidate_id"]: r for r in consolidate.reproject(run.profiles, plain).collect()}
    assert rows["C2"]["phones"] == ["98765-11111"] and rows["C2"]["skills"] == ["react"]
    assert rows["C2"]["location"]["country"] == "India"
    assert "01/09/2020" in [e["start"] for e in rows["C1"]["experience"]]


def test_validation_messages(spark):
    rows = spark.createDataFrame(
        [("K", "bad", ["x@y.org", "no"], ["12"], ("Rome", "Italy"), 3)],
        "candidate_id string, primary_email string, emails array<string>, phones array<string>, location struct<city: string, country: string>, n int",
    )
    fields = [{"path": "primary_email"}, {"path": "n"}, {"path": "location", "type": "array"}]
    told = validation.validate(rows, {"fields": fields}).first()
    assert not told["is_valid"]
    assert told["errors"] == [
        "Schema Mismatch: Field 'n' expected string, got int",
        "Schema Mismatch: Field 'location' expected array, got dict",
        "Email Syntax Error: 'bad' is not a valid email address.",
        "Email List Syntax Error: 'no' is not a valid email address.",
    ]
    assert told["warnings"] == [
        "Phone List Format Warning: '12' does not comply with international E164 format.",
        "ISO Country Code Warning: Location country 'Italy' is not a standard ISO-3166 2-character code.",
    ]


def test_paths(spark):
    rows = spark.createDataFrame([(["a", "b"],)], "emails array<string>")
    at = lambda p: rows.select(projection.path_of(rows.schema, p)[0]).first()[0]
    assert at("emails[0]") == "a" and at("emails[-1]") == "b" and at("emails[5]") is None
    assert projection.path_of(rows.schema, "nothing.there") is None


def test_manifest_and_settings(spark, tmp_path):
    found = manifest.discover(spark, csv_path="a.csv, b.csv", ats_path="x.json").orderBy("ord").collect()
    assert [(r["kind"], r["location"]) for r in found] == [("CSV", "a.csv"), ("CSV", "b.csv"), ("ATS", "x.json")]
    assert reports.sources_found(manifest.discover(spark, csv_path="a")).first()[0] == 1
    (tmp_path / "s.json").write_text('{"on_missing": "omit"}')
    assert manifest.load_settings(str(tmp_path / "s.json"))["on_missing"] == "omit"
    with pytest.raises(ValueError):
        manifest.load_settings(str(tmp_path / "none.json"))
    assert manifest.is_upload("A.PDF") and not manifest.is_upload("a.txt")


def test_no_evidence(spark):
    run = consolidate.run(spark, consolidate.Sources(), SETTINGS)
    assert run.profiles.count() == 0 and run.payloads().count() == 0


def test_stages_are_written(spark, tmp_path):
    rows = spark.createDataFrame([], EVIDENCE)
    reports.write_stages({"extracted": rows}, str(tmp_path / "stages"))
    assert spark.read.parquet(str(tmp_path / "stages/extracted")).columns == rows.columns
    assert set(FIELDS) >= {"emails", "location"}


def test_incremental_stream(spark, tmp_path):
    from veridra.streaming.incremental import consolidate_stream

    first = evidence(spark, [("K", 0, 0, "full_name", "A", "s1", 0.9)])
    first.write.parquet(str(tmp_path / "in"))
    for expected, later in ((["A"], None), (["A", "B"], [("K", 1, 0, "full_name", "B", "s2", 0.95)])):
        if later:
            evidence(spark, later).write.mode("append").parquet(str(tmp_path / "in"))
        arriving = spark.readStream.schema(first.schema).parquet(str(tmp_path / "in"))
        consolidate_stream(arriving, str(tmp_path / "ev"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
        found = spark.read.parquet(str(tmp_path / "out")).orderBy("batch").collect()
        assert [r["full_name"]["value"] for r in found] == expected


def test_command_line(spark, tmp_path, capsys):
    from veridra.__main__ import main

    (tmp_path / "c.csv").write_text(HEADER + "K1,ann other,a@x.example,,,,,,,,python,3\n")
    (tmp_path / "s.json").write_text(json.dumps({"fields": [{"path": "full_name"}], "include_confidence": False, "include_provenance": False}))
    (tmp_path / "r.txt").write_text(RESUME.replace("Ana Prova", "Ann Other"))
    (tmp_path / "g.json").write_text('{"username": "annother", "name": "Ann Other", "languages": ["Go"]}')
    given = ["--config", str(tmp_path / "s.json"), "--csv", str(tmp_path / "c.csv")]
    given += ["--resume", str(tmp_path / "r.txt"), "--github", str(tmp_path / "g.json"), "--stages", str(tmp_path / "out")]
    assert main(given) == 0
    lines = [x for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert [json.loads(x)["full_name"] for x in lines] == ["Ann Other"]
    assert spark.read.parquet(str(tmp_path / "out/merged")).filter("field = 'skills'").count() >= 2
    written = {p.name for p in (tmp_path / "out").iterdir()}
    assert written == {"uploaded_csv", "uploaded_github", "uploaded_resumes", *reports.STAGES, "report"}
    assert spark.read.parquet(str(tmp_path / "out/report")).first()["skills"] >= 2
    assert main(["--config", str(tmp_path / "none.json")]) == 2


def test_later_resume_counts(spark, sources):
    texts = [(p, k, "Resume_PDF", RESUME.replace("Senior engineer", h)) for p, k, h in (("b.pdf", 0, "First"), ("a.pdf", 1, "Second"))]
    resumes = spark.createDataFrame(texts, "resume_path string, resume_ord int, kind string, text string")
    found = consolidate.gather(spark, consolidate.Sources(csv=sources.csv, resumes=resumes))
    headlines = found.filter("field = 'headline' AND profile_ord = 0").collect()
    assert [r["raw"]["text"] for r in headlines] == ["Second"]


def test_skills_found_in_one_search_equal_a_search_for_each(spark):
    import re

    texts = ["python c++ c", "C++x", "java javascript", "machine learning, deep learning", "multi-agent agentic ai", "c# rest-api", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    found = [r[0] for r in rows.select(resume_text.find_skills(F.col("t"))).collect()]
    for text, skills in zip(texts, found):
        wanted = None if text is None else [k for k in resume_text.SKILLS if re.search(rf"\b{re.escape(k)}\b", text.lower())]
        assert skills == wanted


def test_normalisation_shuffles_nothing(spark):
    from veridra.operators import normalize

    rows = [("K", 0, i, "skills" if i % 50 == 0 else "headline", f"ml {i}", "s", 0.9) for i in range(200)]
    plan = normalize.normalize(evidence(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_names_with_a_common_beginning_pair_nobody_else(spark):
    """Containment by the rarest piece gives what all pairs give."""
    left = [(i, f"customer {i:03}") for i in range(60)] + [(60, "cu"), (61, ""), (62, None), (63, "r 01")]
    right = [(i, f"the customer {i:03} of town") for i in range(0, 80, 2)] + [(90, "customer"), (91, "x")]
    names = ("left_key int, their_name string", "right_key int, row_name string")
    found = match.containing(spark.createDataFrame(left, names[0]), spark.createDataFrame(right, names[1]), "their_name", "row_name")
    wanted = {(a, b) for a, s in left for b, t in right if s and t and (s in t or t in s)}
    assert {tuple(r) for r in found.select("left_key", "right_key").collect()} == wanted


def test_work_blocks_of_long_texts(spark):
    lines = [f"line {i}" if i % 5 else f"Firm{i} - Job Jan 2019 - Present" for i in range(2, 2000)]
    texts = spark.createDataFrame([("\n".join(lines),), ("",), (None,), ("only\nlines",)], "t string")
    found = [r[0] for r in texts.select(resume_text.experience_blocks(F.col("t"))).collect()]
    assert len(found[0]) == 400 and found[0][0]["company"] == "line 2" and found[0][1]["company"] == "Firm5"
    assert found[0][1]["summary"] == "line 6\nline 7\nline 8\nline 9"
    assert found[1] == [] and found[2] is None and found[3][0]["summary"] == "lines"


def rows_made(frame):
    """Most rows that a broadcast and that a join of the plan made, once it has run."""
    frame.collect()
    most, open_ = {"Broadcast": 0, "Join": 0}, [frame._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            open_.append(node.executedPlan())
        elif "QueryStage" in node.getClass().getSimpleName():
            open_.append(node.plan())
        elif name.startswith("Reused"):
            continue
        open_.extend(node.children().apply(i) for i in range(node.children().size()))
        made = node.metrics().get("numOutputRows")
        kind = "Broadcast" if name == "BroadcastExchange" else "Join" if name.endswith("Join") else None
        if kind and made.isDefined():
            most[kind] = max(most[kind], made.get().value())
    return most


def stored(spark, path, rows, schema):
    """Rows in a file, whose size Spark knows: it then plans broadcasts."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path))
    return spark.read.parquet(str(path))


def alike(spark, path):
    """Rows and names that nearly all match one another, 400 each."""
    rows = [(str(i), f"Customer#{i:09}", f"c{i}@x.org", i) for i in range(400)]
    return stored(spark, path, rows, "candidate_id string, full_name string, email string, csv_ord int")


def matched_rows(spark):
    names = ["Ana Prova", "ana prova", "Bo", "b", None, "", " ", "x" * 70 + " one", "the " + "x" * 70 + " one and more", "x" * 70, "cu", "Customer 01", "y" * 200]
    rows = [(str(100 + i), n, None if i % 3 else f"M{i // 6}@x.org ", i) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "candidate_id string, full_name string, email string, csv_ord int"), rows


MATCHING_NAMES = ["prova", "PROVA ", None, "", "o", "dr ana prova iii", "x" * 69, "x" * 70 + " one", "a " + "x" * 70 + " one", "zz", "er 0", "y" * 65, "y" * 201, "customer 011"]


def first_of(rows, meets):
    return next((key for key, name, mail, _ in rows if meets((name or "").lower().strip(), (mail or "").lower().strip())), None)


def either_way(mine, name):
    return bool(mine and name and (mine in name or name in mine))


@pytest.mark.parametrize("longest", [64, 3])
def test_first_row_of_a_profile_is_that_of_all_pairs(spark, monkeypatch, longest):
    monkeypatch.setattr(match, "LONGEST", longest)
    table, rows = matched_rows(spark)
    people = [(u, n) for u, n in zip([*"abcdefghij", "Er 0", "BO", "", "nobody"], MATCHING_NAMES)]
    found = {r["username"]: r["candidate_id"] for r in match.match_profiles(spark.createDataFrame(people, "username string, name string"), table).collect()}
    wanted = {u: first_of(rows, lambda name, _: either_way((n or "").lower().strip(), name) or bool(u and name and u.lower() in name)) for u, n in people}
    assert found == wanted


def test_profiles_that_match_many_rows_make_no_pairs(spark, tmp_path):
    """Neither pairs nor the pieces of names, which were broadcast: that failed at 900,000 rows."""
    people = [(f"r#{i:09}", "000" if i % 2 else f"customer#{i:09}") for i in range(400)]
    found = match.match_profiles(stored(spark, tmp_path / "p", people, "username string, name string"), alike(spark, tmp_path / "c"))
    made = rows_made(found)
    assert made["Broadcast"] <= 800 and made["Join"] <= 20 * 800
    assert {r["username"]: r["candidate_id"] for r in found.collect()} == {f"r#{i:09}": "0" if i % 2 else str(i) for i in range(400)}


@pytest.mark.parametrize("longest", [64, 3])
def test_first_row_of_a_resume_is_that_of_all_pairs(spark, monkeypatch, longest):
    monkeypatch.setattr(match, "LONGEST", longest)
    table, rows = matched_rows(spark)
    papers = [(f"{i:02}.pdf", n, [[], None, ["m1@X.org"], ["none@x.org", " M0@x.org"], [None, ""]][i % 5]) for i, n in enumerate(MATCHING_NAMES)]
    found = match.match_resumes(spark.createDataFrame(papers, "resume_path string, name string, emails array<string>"), table)
    wanted = {p: first_of(rows, lambda name, mail: either_way((n or "").lower().strip(), name) or bool(mail) and mail in [(m or "").lower().strip() for m in ms or []]) for p, n, ms in papers}
    assert {r["resume_path"]: r["candidate_id"] for r in found.collect()} == wanted


def test_resumes_that_match_many_rows_make_no_pairs(spark, tmp_path):
    papers = [(f"{i}.pdf", f"mr customer#{i:09} junior" if i % 2 else "customer", [f"C{i}@X.org"] if i % 4 == 0 else []) for i in range(400)]
    found = match.match_resumes(stored(spark, tmp_path / "p", papers, "resume_path string, name string, emails array<string>"), alike(spark, tmp_path / "c"))
    made = rows_made(found)
    assert made["Broadcast"] <= 800 and made["Join"] <= 20 * 800
    assert {r["resume_path"]: r["candidate_id"] for r in found.collect()} == {f"{i}.pdf": str(i) if i % 2 else "0" for i in range(400)}


def test_resolving_an_id_makes_no_pairs(spark, tmp_path):
    rows = alike(spark, tmp_path / "c")
    resumes = match.match_resumes(stored(spark, tmp_path / "r", [(f"{i}.pdf", "nobody", ["none"]) for i in range(400)], "resume_path string, name string, emails array<string>"), rows)
    people = [(f"u{i:03}", "000" if i else "customer#000000007") for i in range(400)]
    profiles = match.match_profiles(stored(spark, tmp_path / "p", people, "username string, name string"), rows)
    one = match.resolve_id("AUTO", resumes, profiles, rows)
    made = rows_made(one)
    assert made["Broadcast"] <= 800 and made["Join"] <= 20 * 800
    assert one.first()["candidate_id"] == "7"
