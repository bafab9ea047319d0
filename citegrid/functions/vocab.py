"""Fixed values of the record format: reserved field names, type names and patterns."""

#: Fields that hold workflow state. They are not part of a record's content.
WORKFLOW_FIELDS = (
    "integrity", "bibsource", "bibprovider", "bibproviderid", "bibprevious", "bibapprovalid", "bibapprovalkind",
    "bibapprovalmethod", "bibapprovalreviewer", "bibapprovalcontent", "bibapprovaltimestamp", "bibapprovalbatch",
)

#: Fields that a provider's record replaces when it is adopted; all others are local and kept.
CONTROLLED_FIELDS = (
    "title", "author", "editor", "journal", "booktitle", "publisher", "year", "month", "volume", "number", "pages",
    "eid", "doi", "url", "isbn", "issn", "bibprovider", "bibproviderid",
)

#: Fields of a human approval.
APPROVAL_FIELDS = (
    "bibapprovalid", "bibapprovalkind", "bibapprovalmethod", "bibapprovalreviewer", "bibapprovalcontent",
    "bibapprovaltimestamp", "bibapprovalbatch",
)

#: Entry types that hold evidence and history, not literature.
SYSTEM_TYPES = ("bibsource", "bibversion")

#: Entry type to common record type, and back. Other types stay, and go to "misc".
COMMON_TYPE = {
    "article": "journal-article", "inproceedings": "proceedings-article", "incollection": "book-chapter",
    "book": "book", "phdthesis": "dissertation", "techreport": "report",
}
ENTRY_TYPE = {
    "journal-article": "article", "proceedings-article": "inproceedings", "book-chapter": "incollection",
    "reference-entry": "incollection", "book": "book", "edited-book": "book", "monograph": "book",
    "reference-book": "book", "dissertation": "phdthesis", "report": "techreport",
}

DOI_PATTERN = r"(?i)10\.\d{4,9}/[-._;()/:a-z0-9]+"
ARXIV_PATTERN = r"(?i)(?:arxiv\.org/(?:abs|pdf|html)/|arxiv:)([a-z-]+/\d{7}|\d{4}\.\d{4,5})(?:v\d+)?"
#: HTML meta names that can hold a DOI.
META_NAMES = ("citation_doi", "dc.identifier.doi", "dc.identifier", "prism.doi")
