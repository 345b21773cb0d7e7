"""A synthetic document in the layout that the parser knows."""


def page(container: str = "vaticanrichtext", chapters: bool = True, date: str = "the 25th day of March, in the year 2001", extra: str = "") -> str:
    note = lambda n: f'<a href="#_ftn{n}" name="_ftnref{n}">[{n}]</a>'
    body = [
        "<p><b>ENCYCLICAL LETTER<br>SPES NOVA<br>OF THE SUPREME PONTIFF<br>BENEDICT XVI<br>TO THE BISHOPS<br>PRIESTS AND DEACONS<br>ON A NEW HOPE</b></p>",
        "<p>Contents and more</p><p>&nbsp;</p>",
        "<p><b>Introduction</b></p>",
        f"<p>1. <i>Spes nova</i>, a first word{note(1)} of the text.</p>",
        "<p>A continuation of the first.</p>",
        f"<p>2. Second, see {note(2)}.</p>",
    ]
    if chapters:
        body += ["<p><b>CHAPTER ONE</b></p><p><b>THE WAY OF</b></p><p><b>THE WORLD.</b></p>", "<p>3.Third.</p>", "<p><b>A section</b></p>", f"<p>4. Fourth{note(3)}.</p>", "<p><b>II. Second part</b></p>", "<p>5. Fifth.</p>"]
    body += [f"<p><i>Given in Rome, on {date}.</i></p>", "<p></p><p><b>BENEDICTUS PP. XVI</b></p>", extra]
    notes = [f'<p><a href="#_ftnref{n}" name="_ftn{n}">[{n}]</a> Note {n} text.</p>' for n in (1, 2)] + ['<p><a name="_ftn3"></a>3] Third note.</p>']
    return f'<html><head><link rel="canonical" href="https://x.example/doc.html"></head><body><div class="{container}">{"".join(body)}<hr>{"".join(notes)}</div></body></html>'
