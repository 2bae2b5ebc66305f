"""Form types, their codes, and the status and grade vocabularies."""

# One row per form type.
# type_id, type_code, type_name, hint, kind, title, class_code, class_label, folder, pipeline_type
FORM_TYPES = [
    (1, "BIRTH", "Birth Certificate", "1A", "birth", "Birth Certificate",
     "form102", "Form 102 - Certificate of Live Birth", "form1a", "birth"),
    (2, "DEATH", "Death Certificate", "2A", "death", "Death Certificate",
     "form103", "Form 103 - Certificate of Death", "form2a", "death"),
    (3, "MARRCERT", "Marriage Certificate", "3A", "marriage-cert", "Marriage Certificate",
     "form97", "Form 97 - Certificate of Marriage", "form3a", "marriage"),
    (4, "MARRLIC", "Marriage License", "90", "marriage-license", "Marriage License Application",
     "form90", "Form 90 - Application for Marriage License", "form90", "marriage"),
]

FORM_TYPE_COLUMNS = (
    "type_id", "type_code", "type_name", "hint", "kind", "title",
    "class_code", "class_label", "folder", "pipeline_type",
)

# The three classes the text classifier knows, in tie order.
TEXT_CLASSES = ("form102", "form103", "form97")

# Document status domain.
STATUSES = ("Pending", "Approved", "Rejected", "Processed")

# Label prefix -> form hint (first match wins, default 1A).
LABEL_PREFIX_HINTS = (("F102", "1A"), ("F103", "2A"), ("F97", "3A"))

# Accepted upload extensions.
UPLOAD_EXTENSIONS = ("jpg", "jpeg", "png", "pdf")
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png")

# Required fields per form folder.
REQUIRED_FIELDS = {
    "form1a": ("name", "date_of_birth", "place_of_birth"),
    "form2a": ("name", "date_of_death", "place_of_death"),
    "form3a": ("husband_name", "wife_name", "date_of_marriage"),
    "form90": ("husband_name", "wife_name", "date_of_application"),
}

# Grade bands, (threshold, name) from best to worst.
REPORT_GRADES = ((90, "EXCELLENT"), (75, "GOOD"), (60, "ACCEPTABLE"), (None, "NEEDS IMPROVEMENT"))
RECALL_GRADES = ((70, "GOOD"), (40, "PARTIAL"), (None, "POOR"))
ACCURACY_MARKS = ((70, "pass"), (50, "warn"), (None, "fail"))


def column_map(key: str, value: str) -> dict:
    """Map one code column of FORM_TYPES to another."""
    k, v = FORM_TYPE_COLUMNS.index(key), FORM_TYPE_COLUMNS.index(value)
    return {row[k]: row[v] for row in FORM_TYPES}
