"""Fixed values shared by the operators."""

# --- Fixed values: the thirteen operations of a catalog, by kind -------------------------------
ACTIONS = ["CREATE", "RETRIEVEALL", "UPDATE", "UPDATEALL", "DELETEALL", "UPSERTWITHWHERE"]
TRIGGERS = [
    "CREATED",
    "CREATEDORUPDATED",
    "UPDATED",
    "DELETED",
    "CREATED_POLLER",
    "UPDATED_POLLER",
    "CREATEDORUPDATED_POLLER",
]
KINDS = ["actions", "triggers"]
ANY_KIND = "any"

# --- Fixed values: utterance template of each operation ----------------------------------------
TEMPLATES = {
    "CREATE": "Create a {app} {object}.",
    "RETRIEVEALL": "Retrieve all {app} {object}.",
    "UPDATE": "Update a {app} {object}.",
    "UPDATEALL": "Update all {app} {object}.",
    "DELETEALL": "Delete all {app} {object}.",
    "UPSERTWITHWHERE": "Update or create a {app} {object}.",
    "CREATED": "Triggers when a {app} {object} is created.",
    "CREATEDORUPDATED": "Triggers when a {app} {object} is created or updated.",
    "UPDATED": "Triggers when a {app} {object} is updated.",
    "DELETED": "Triggers when a {app} {object} is deleted.",
    "CREATED_POLLER": "Triggers when a {app} {object} is created.",
    "UPDATED_POLLER": "Triggers when a {app} {object} is updated.",
    "CREATEDORUPDATED_POLLER": "Triggers when a {app} {object} is created or updated.",
}

# --- Fixed values: element type tags -----------------------------------------------------------
TAG_APP, TAG_OBJECT, TAG_OPERATION = "app", "bo", "op"

# --- Fixed values: `version` of catalog records that use the nested dialect --------------------
NESTED_VERSION = "cp4i"

# --- Fixed values: placeholder application that a listing may hold -----------------------------
DUMMY_APPS = ["streaming-connector-scheduler"]

# --- Fixed values: kind corrections (app, object, operation, kind) -----------------------------
KIND_PATCHES = [("gmail", "mail", "CREATED", "triggers")]

# --- Fixed values: share of each level in the distance of a match, rows kept per level ---------
WEIGHT_APP, WEIGHT_OBJECT, WEIGHT_OPERATION = 0.8, 0.6, 0.4
MATCH_TOP = 5

# --- Fixed values: sampling sizes --------------------------------------------------------------
SECOND_PICK_FRACTION = 0.1
PER_TRIGGER_APP = 250
EVAL_OBJECTS = 25
EVAL_COMPOSED = 1000
EVAL_ACTIONS_PER_APP = 4

# --- Fixed values: types of samples that are paraphrased, fuzzy threshold ----------------------
SAMPLE_TYPES = [1, 2, 3, 4, 5, 6, 7, 8]
PARAPHRASED_TYPES = [2, 3, 5, 6, 7, 8]
FUZZY_THRESHOLD = 80

# --- Fixed values: separator of path and description in a retrieval document --------------------
DOCUMENT_SEPARATOR = " Flow description: "

# --- Fixed values: prompt layouts. {u} utterance, {eos} end token, {apps} application names,
# --- {pairs} "description: path" lines, {paths} path lines ---------------------------------------
PROMPT_LAYOUTS = {
    "pairs_and_apps": (
        " Given the user utterance in <> below, produce an API call or calls \n"
        "    where a single api call can be similar or one of the following (description, call) pairs:\n"
        "{pairs}"
        "    \n"
        "    The first  part of the API calls, namely the applications should take values from the following set:\n"
        "    applications = {{apps}}\n"
        "    \n"
        "    Output just the triplet(s) of API calls without explanations!\n"
        "    \n"
        "    utterance: <{u} {eos}>\n"
        "    "
    ),
    "paths": (
        " Given the user utterance in <> below, produce an API call or calls \n"
        "    where a single api call can be similar or one of the following API calls:\n"
        "{paths}"
        "    \n"
        "    Output just the triplet(s) of API calls without explanations!\n"
        "    \n"
        "    utterance: <{u} {eos}>\n"
        "    "
    ),
    "options": (
        " utterance: <{u} {eos}>\n"
        "    Output can be one of those:\n"
        "{paths}"
        "    "
    ),
    "conversational": (
        " Given the user utterance in <> below, produce an API call or calls in a form of a triplet:\n"
        "    application.object.operation\n"
        "    \n"
        "    where the application takes value from the following application set:\n"
        "    \n"
        "    applications = {{apps}}\n"
        "    \n"
        "    utterance = <{u} {eos}>\n"
        "    \n"
        "    Output just the triplet(s) with if or for statements if needed without any comments or additional"
        " explanations. In case of if statement if condition is not known - state if CONDITION.\n"
        "    Output just triplet(s).\n"
        "    \n"
        "    "
    ),
    "apps": (
        " Given the user utterance in <> below, produce an API call or calls in a form of a triplet:\n"
        "    [application.object.operation]\n"
        "    \n"
        "    where application takes value from the following application set:\n"
        "    \n"
        "    applications = {{apps}}\n"
        "    \n"
        "    Output just the triplet of API calls without explanations!\n"
        "    utterance: <{u} {eos}>\n"
        "    "
    ),
}
CLARIFICATION = "{u}, I mean for {app}. Output just triplet(s)."

# --- Small dictionary of usual words, for a lemmatiser that is given no table -------------------
VERBS = [
    "add", "archive", "assign", "call", "cancel", "change", "close", "copy", "create", "delete",
    "download", "find", "get", "insert", "invoke", "list", "merge", "modify", "move", "open",
    "post", "publish", "query", "read", "receive", "remove", "replace", "retrieve", "return", "run",
    "save", "search", "send", "set", "share", "start", "stop", "store", "submit", "sync",
    "trigger", "update", "upload", "upsert", "view", "write",
]
NOUNS = [
    "account", "attachment", "attendee", "bucket", "campaign", "case", "channel", "comment", "company", "contact",
    "customer", "deal", "document", "email", "employee", "event", "file", "folder", "group", "invoice",
    "issue", "item", "lead", "list", "member", "message", "note", "opportunity", "order", "payment",
    "product", "project", "record", "row", "tag", "task", "ticket", "user", "worksheet",
]
# Inflection rules: (suffix of the surface form, suffix of the dictionary form).
VERB_RULES = [("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", "")]
NOUN_RULES = [("s", ""), ("ses", "s"), ("ies", "y"), ("xes", "x"), ("ches", "ch"), ("shes", "sh"), ("men", "man")]
