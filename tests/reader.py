"""One-document-at-a-time reader of the extraction rules, for comparison only."""

LABELS = {"Yes", "No"}


class Rejected(Exception):
    pass


def asks(text):
    return "?" in text or text.endswith(":")


def read(elements, null_is_blank=True):
    """Items of one document as (idx, type, question, text, flag, section)."""

    def stripped(i):
        if elements[i]["text"] is None:
            if not null_is_blank:
                raise Rejected(i)
            return ""
        return elements[i]["text"].strip()

    titled = any(e["type"] == "Title" for e in elements)
    section = None if titled else "Document Content"
    items, waiting, skip = [], None, False
    for i, e in enumerate(elements):
        if skip:
            skip = False
            continue
        text = (e["text"] or "").strip()
        if e["type"] == "Title":
            section = text
            if text:
                items.append((i, "text", None, text, None, section))
            continue
        if '<input class="Checkbox"' in e["html"]:
            ticked = "checked" in e["html"]
            label = None
            if i > 0 and stripped(i - 1) in LABELS:
                label = stripped(i - 1)
            elif i + 1 < len(elements) and stripped(i + 1) in LABELS:
                label = stripped(i + 1)
            if label:
                question, waiting = waiting, None
                if not question:
                    question = "Unknown question"
                    for j in (i - 1, i - 2, i - 3, i - 4):
                        if j < 1:
                            break
                        if asks(stripped(j)):
                            question = stripped(j)
                            break
                if section is not None:
                    flag = (label == "Yes") if ticked else None
                    items.append((i, "checkbox", question, None, flag, section))
                skip = i + 1 < len(elements) and stripped(i + 1) in LABELS
                continue
        if section is None:
            continue
        if e["type"] == "Image":
            items.append((i, "image", None, None, None, section))
        elif e["type"] == "Header":
            if text:
                items.append((i, "text", None, text, None, section))
        elif text and text not in LABELS:
            items.append((i, "text", None, text, None, section))
            if asks(text):
                waiting = text
    return items
