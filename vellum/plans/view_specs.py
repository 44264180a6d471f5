"""The declarative views: fixed values of the view files, as the compiler reads them."""

_IN = "file.inFolder({!r})".format
_OUT = [{"not": [_IN(f)]} for f in ("90-templates", "99-system", "09-archive")]
_MD = 'file.ext == "md"'


def _type(*names: str):
    each = [f'type == "{n}"' for n in names]
    return each[0] if len(each) == 1 else {"or": each}


def _view(name: str, filters: list, sort: list[tuple[str, str]], limit: int) -> dict:
    return {"name": name, "filters": {"and": filters}, "order": ["file.path", "type", "date"], "sort": [{"property": p, "direction": d} for p, d in sort], "limit": limit}


JOURNAL = {
    "filters": {"and": [_MD, _IN("01-journal")]},
    "views": [
        _view("Recent Dailies", [_IN("01-journal/daily")], [("file.name", "DESC")], 14),
        _view("Weekly Reviews", [_IN("01-journal/weekly")], [("date", "DESC")], 26),
        _view("Monthly Reviews", [_IN("01-journal/monthly")], [("date", "DESC")], 12),
        _view("Quarterly Reviews", [_IN("01-journal/quarterly")], [("date", "DESC")], 12),
    ],
}
OVERVIEW = {
    "filters": {"and": [_MD, *_OUT]},
    "views": [
        _view("Projects", [_type("project")], [("due", "ASC"), ("file.name", "ASC")], 50),
        _view("Attention", [_type("project"), {"or": ['health == "red"', 'health == "yellow"', 'state == "waiting"', 'state == "on-hold"']}], [("health", "ASC"), ("due", "ASC")], 50),
        _view("Open Decisions", [_type("decision"), 'state == "open"'], [("date", "ASC")], 50),
        _view("Decisions", [_type("decision")], [("date", "DESC")], 100),
        _view("Recent Meetings", [_type("meeting")], [("date", "DESC")], 15),
        _view("Waiting", ['state == "waiting"'], [("date", "ASC")], 50),
        _view("Reviews", [_type("weekly", "monthly", "quarterly", "retro")], [("date", "DESC")], 30),
        _view("Knowledge", [_type("concept", "runbook", "spec")], [("file.mtime", "DESC")], 100),
        _view("Needs Review", [{"or": ['status == "draft"', {"and": ["stale_after.isTruthy()", "date(stale_after) < today()"]}]}], [("stale_after", "ASC")], 50),
        _view("Recently Touched", ["type.isTruthy()", {"not": [_IN("00-home")]}, {"not": [_IN("01-journal")]}], [("file.mtime", "DESC")], 12),
    ],
}
PEOPLE = {
    "filters": {"and": [_MD, _type("person", "team"), {"not": [_IN("90-templates")]}, {"not": [_IN("09-archive")]}]},
    "views": [
        _view("People", [_type("person")], [("next_1_1", "ASC"), ("file.name", "ASC")], 100),
        _view("Teams", [_type("team")], [("file.name", "ASC")], 50),
    ],
}

#: Query name to view file, view, and the SQL of its condition and order.
_J = "rel like '01-journal/%'"
_O = "rel not like '90-templates/%' and rel not like '99-system/%' and rel not like '09-archive/%'"
_P = "type in ('person', 'team') and rel not like '90-templates/%' and rel not like '09-archive/%'"
VIEWS = {
    "view_recent_dailies": (JOURNAL, "Recent Dailies", f"{_J} and rel like '01-journal/daily/%'", "name desc", 14),
    "view_weekly_reviews": (JOURNAL, "Weekly Reviews", f"{_J} and rel like '01-journal/weekly/%'", "date desc", 26),
    "view_monthly_reviews": (JOURNAL, "Monthly Reviews", f"{_J} and rel like '01-journal/monthly/%'", "date desc", 12),
    "view_quarterly_reviews": (JOURNAL, "Quarterly Reviews", f"{_J} and rel like '01-journal/quarterly/%'", "date desc", 12),
    "view_projects": (OVERVIEW, "Projects", f"{_O} and type = 'project'", "due, name", 50),
    "view_attention": (OVERVIEW, "Attention", f"{_O} and type = 'project' and (health in ('red', 'yellow') or state in ('waiting', 'on-hold'))", "health, due", 50),
    "view_open_decisions": (OVERVIEW, "Open Decisions", f"{_O} and type = 'decision' and state = 'open'", "date", 50),
    "view_decisions": (OVERVIEW, "Decisions", f"{_O} and type = 'decision'", "date desc", 100),
    "view_recent_meetings": (OVERVIEW, "Recent Meetings", f"{_O} and type = 'meeting'", "date desc", 15),
    "view_waiting": (OVERVIEW, "Waiting", f"{_O} and state = 'waiting'", "date", 50),
    "view_reviews": (OVERVIEW, "Reviews", f"{_O} and type in ('weekly', 'monthly', 'quarterly', 'retro')", "date desc", 30),
    "view_knowledge": (OVERVIEW, "Knowledge", f"{_O} and type in ('concept', 'runbook', 'spec')", "mtime desc", 100),
    "view_needs_review": (OVERVIEW, "Needs Review", f"{_O} and (status = 'draft' or (stale_after is not null and stale_after[:10]::date < date '1998-06-17'))", "stale_after nulls last", 50),
    "view_recently_touched": (OVERVIEW, "Recently Touched", f"{_O} and type <> '' and rel not like '00-home/%' and rel not like '01-journal/%'", "mtime desc", 12),
    "view_people": (PEOPLE, "People", f"{_P} and type = 'person'", "next_1_1, name", 100),
    "view_teams": (PEOPLE, "Teams", f"{_P} and type = 'team'", "name", 50),
}
