import datetime as dt
import textwrap

import pytest

from vellum.engine import Engine

NOW = dt.datetime(2026, 9, 15, 12, 0, tzinfo=dt.UTC)


def note(front: str, body: str = "") -> str:
    return f"---\n{textwrap.dedent(front).strip()}\n---\n{textwrap.dedent(body)}"


GOOD = "description: fine\ngenerated: { by: human:ann, at: 2026-01-01T00:00:00Z }"

FILES = {
    ".obsidian/templates.json": '{"folder": "90-templates"}',
    ".obsidian/daily-notes.json": '{"folder": "01-journal", "format": "[daily]/YYYY/MM/YYYY-MM-DD", "template": "90-templates/daily.md"}',
    "90-templates/daily.md": "---\ntype: daily\ntitle: '{{title}}'\ndate: {{date}}\ndescription: ''\ngenerated: { by: human:ann, at: 2026-01-01T00:00:00Z }\n---\n# {{date:dddd [the] DD}}\n",
    "90-templates/meeting.md": "---\ntype: meeting\ntitle: x\ndate: 2000-01-01\ngenerated: { by: human:ann }\n---\n# {{title}}\n\n## Outcomes\n\n- (what came out)\n\n## Decisions\n\n- (link [the decision](../06-decisions/d1.md))\n\n## Actions\n\n## Recap\n\n*Before closing: check*\n",
    "index.md": '---\nokf_version: "0.2"\n---\n',
    "log.md": "# Log\n\n## 2026-09-01\n* **Update**: older\n",
    "Inbox.md": "raw capture without frontmatter\n",
    "05-people/ann-bee.md": note(f"type: person\ntitle: Ann Bee\naliases: [Annie]\n{GOOD}"),
    "05-people/will-fox.md": note(f"type: person\ntitle: Will Fox\nteam: core crew\n{GOOD}", "[[Ann-Bee]]\n"),
    "03-projects/apollo.md": note(
        f"type: project\ntitle: Apollo\nowner: Ann Bee\nstate: active\nhealth: amber\nmilestone: Beta\ndue: 2026-10-01\n{GOOD}\nverified: {{ by: human:ann, at: 2026-02-01T00:00:00Z }}",
        """
        - [ ] ship the beta build — Ann Bee, due 2026-09-10
        - [ ] write the launch notes — me, due 2026-09-20
        ```
        - [ ] not a task
        ```
        - [x] order the big screen
        """,
    ),
    "03-projects/projects.md": note(f"type: system\ntitle: Projects\n{GOOD}", "\n## One-liners\n\n| Project | Health | State | Next milestone | One line |\n|---|---|---|---|---|\n| [Apollo](apollo.md) | green | active | Beta 2026-10-01 | my words |\n| gone | | | | |\n"),
    "03-projects/hermes.md": note(f"type: project\ntitle: Hermes\nowner: will\nstate: active\nhealth: purple\n{GOOD}", "- [ ] order the big screen\n"),
    "06-decisions/d1.md": note(f"type: decision\ntitle: D one\ndate: 2026-01-01\nproject: Apollo\nstate: decided\n{GOOD}"),
    "06-decisions/d2.md": note(f"type: decision\ntitle: D two\ndate: 2026-02-01\nproject: '[Apollo](../03-projects/apollo.md)'\nsupersedes: D one\nstate: decided\n{GOOD}"),
    "06-decisions/d3.md": note(f"type: decision\ntitle: D three\ndate: 2026-03-01\nproject: Apollo\nsupersedes: '[[d2]]'\nstate: open\n{GOOD}"),
    "06-decisions/lone.md": note(f"type: decision\ntitle: Lone\nstate: open\n{GOOD}"),
    "06-decisions/decision-log.md": note(f"type: system\ntitle: Log of decisions\n{GOOD}", "## Register\n\n| Date | Decision | State | Note |\n|---|---|---|---|\n| 2026-01-01 | D one | decided | [note](d1.md) |\n| 2026-02-02 | D two | decided | [note](d2.md) |\n"),
    "00-home/priorities.md": note(f"type: system\ntitle: Priorities\n{GOOD}", "## Open decisions\n\n- D three\n\n## Next\n"),
    "07-knowledge/old.md": note(f"type: concept\ntitle: Old\nstale_after: 2026-01-01T00:00:00Z\n{GOOD}"),
    "07-knowledge/spec.md": note(f"type: spec\ntitle: Spec\nproject: Apollo\nsummary: by alias\nsources:\n  - {{ id: a, resource: 'https://a.example', title: A }}\n  - {{ id: b, resource: 'https://b.example' }}\ngenerated: {{ by: agent/1, at: 2026-01-01T00:00:00Z }}", "Relies on [[old]] and [^a].\n<!-- [[lone]] --> %% [[lone]] %%\n\n[^a]: note\n"),
    "07-knowledge/secret.md": note(f"type: concept\ntitle: Secret\nsensitivity: confidential\n{GOOD}", "hidden launch words\n"),
    "07-knowledge/bad-yaml.md": "---\ntype: [\n---\nbody\n",
    "07-knowledge/bad-date.md": "---\ntype: concept\ndate: 2026-13-45\n---\n",
    "02-meetings/m.md": note(f"type: meeting note\ntitle: Meeting\nmy key: 7\nowner: '[Gone](../05-people/gone.md)'\n{GOOD}", "[a](../03-projects/apollo.md) [b](missing.md) ![[list.base#All]] ![[list.base#None]] [[nowhere]]\n"),
    "00-home/list.base": "views:\n  - name: All\n",
}


@pytest.fixture
def vault(tmp_path):
    for rel, text in FILES.items():
        path = tmp_path / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    (tmp_path / "07-knowledge/utf16.md").write_bytes("---\ntype: concept\n---\n".encode("utf-16"))
    (tmp_path / "07-knowledge/bom.md").write_bytes(b"\xef\xbb\xbf" + note(f"type: concept\ntitle: Bom\n{GOOD}").encode())
    (tmp_path / "_private").mkdir()
    (tmp_path / "_private/x.md").write_text("never read")
    return tmp_path


@pytest.fixture
def engine(spark, vault):
    return Engine(spark, str(vault), now=NOW)
