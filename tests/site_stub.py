"""Feeds of all four kinds, one of them down, for the run from end to end."""

import json

ICS = "\r\n".join([
    "BEGIN:VCALENDAR", "BEGIN:VEVENT", "UID:own", "SUMMARY:Kernel night", "DTSTART;TZID=America/Chicago:20260107T180000", "LOCATION:The Hall\\, Room 30\\, 1 Main St\\, Town\\, TX 77002\\, USA", "END:VEVENT",
    "BEGIN:VEVENT", "UID:weekly", "SUMMARY:Lunch", "DTSTART;TZID=America/Chicago:20260105T120000", "RRULE:FREQ=WEEKLY;COUNT=3", "END:VEVENT", "END:VCALENDAR",
])
PAGE = {"total": 3, "events": [
    {"global_id": "v1", "title": "Kernel &amp; friends", "description": "<p>Talks &amp; pizza</p>", "utc_start_date": "2026-01-08 00:00:00", "utc_end_date": "2026-01-08 02:00:00", "url": "hall.example/e/1", "organizer": [{"organizer": "linux people"}], "venue": [{"venue": "Hall &#8211; Lobby"}, {"venue": "Hall"}]},
    {"global_id": "v2", "title": "Open house", "utc_start_date": "2026-01-09 00:00:00", "venue": {"venue": "Barn", "city": "Town"}},
    {"title": "without an id", "utc_start_date": "2026-01-09 00:00:00"},
]}
CARDS = '<div class="meeting-card-compact"><h3 class="meeting-week">First Wednesday</h3><time datetime="2026-01-14T18:00:00-06:00">x</time><p class="meeting-location">the hall</p></div>'
LINKED = '<link rel="canonical" href="https://chap.example/events/details/a/"><script type="application/ld+json">{"@type": "Event", "name": "Chapter day", "startDate": "2026-01-20T10:00:00-06:00", "eventAttendanceMode": "https://schema.org/OnlineEventAttendanceMode"}</script>'
SITE = {
    "https://linux.example/cal.ics": ICS, "https://open.example/": CARDS, "https://chap.example/": '<a href="/events/details/a/">a</a>', "https://chap.example/events/details/a/": LINKED,
}


def get(url: str) -> tuple[int, bytes]:
    if url.startswith("https://hall.example/json?"):
        return 200, json.dumps(PAGE).encode()
    if url == "https://down.example/cal.ics":
        raise OSError("no route")
    return (200, SITE[url].encode()) if url in SITE else (404, b"")
