"""What reports tell about each rule: one entry of :class:`Prose` for every rule id.

A rule that has several forms (ratings, places) shares one entry. Rules of users, and ids
without an entry, get the general text of :func:`prose_of`.
"""

from __future__ import annotations

from typing import NamedTuple

_WEAKNESS = "https://cwe.mitre.org/data/definitions/{}.html"
#: Kinds of grounds on which a rule fires; told as the reason for its confidence.
_WORDS = "The text of this line has the form the rule looks for"
_INPUT = "Request data and the call that uses it stand in one line"
_ABSENT = "No file of the repository shows what the rule looks for"
_SETTING = "The setting is written out in a configuration file"


class Prose(NamedTuple):
    description: str
    impact: str
    production_impact: str
    remediation: str
    confidence_reason: str
    #: Weakness number of the public list, or addresses of documentation.
    sources: tuple = ()

    @property
    def references(self) -> list[str]:
        return [_WEAKNESS.format(s) if isinstance(s, int) else s for s in self.sources]


RULE_PROSE: dict[str, Prose] = {
    "SECRET-001": Prose(
        "A key with the prefix of a known provider is written into a file.",
        "Whoever reads the repository can call the provider in your name.",
        "The key stays valid in old clones until it is revoked; use of it appears on your bill.",
        "Revoke the key, issue a new one and read it from a secret store at start.",
        f"{_WORDS}: the provider's own key prefix and length.", (798,),
    ),
    "SECRET-002": Prose(
        "An address carries a user name and password.",
        "Readers of the repository can log in to the addressed service.",
        "Addresses end up in logs and error messages, and the password with them.",
        "Keep the address without login data and supply the login from the environment.",
        f"{_WORDS}: a login before the host of an address.", (798, 522),
    ),
    "SECRET-003": Prose(
        "A name that stands for a secret is assigned a quoted value.",
        "The value, if real, is known to every reader of the repository.",
        "One value serves all stages, so a leak in testing opens production.",
        "Read the value from the environment or a secret store.",
        "Name and quoted value fit; whether the value is real cannot be seen from the text.", (798,),
    ),
    "SECRET-004": Prose(
        "A private key is stored as text.",
        "Its holder can sign, decrypt or log in as the owner.",
        "All certificates and tokens made with the key lose their worth at once.",
        "Replace the key pair, keep the new key in a key store and clean the history.",
        f"{_WORDS}: the head of a key block.", (321,),
    ),
    "SECRET-005": Prose(
        "A signed web token is written into a file.",
        "Until it expires, the token gives its owner's rights to any reader.",
        "Tokens without an expiry work for as long as the signing key does.",
        "Remove the token, change the signing key if the token is live, and create tokens in test code.",
        "Three encoded parts make a token; whether it is live cannot be seen.", (522,),
    ),
    "CONFIG-001": Prose(
        "An environment file is part of the repository.",
        "Its values are shared with everyone who can clone.",
        "Values of production are changed by commits and rolled back with them.",
        "Remove the file, list it in the ignore file and commit an example without values.",
        "The file's own name tells what it is.", (538, "https://12factor.net/config"),
    ),
    "CONFIG-002": Prose(
        "Configuration of production names the local machine as a host.",
        "The service looks for its partners in its own container.",
        "Calls fail after deployment, or reach a forgotten local process.",
        "Set the host for each stage from the environment.",
        _SETTING + ".", ("https://12factor.net/backing-services",),
    ),
    "CONFIG-003": Prose(
        "Debug mode is switched on.",
        "Error pages show source, settings and variables.",
        "Debug servers are slow, reload code and may offer a console to visitors.",
        "Switch it off by default and on by the environment of development only.",
        _SETTING + "; another file may override it.", (489,),
    ),
    "CONFIG-004": Prose(
        "A variable that is built into client code bears the name of a secret.",
        "Every visitor can read it from the delivered script.",
        "The value is cached by browsers and networks and cannot be called back.",
        "Drop the public prefix and use the value on the server only.",
        "The prefix alone decides that a build tool publishes the variable.", (200,),
    ),
    "CONFIG-005": Prose(
        "The example file names variables that the active environment file lacks.",
        "Features that need them fail or fall back to defaults.",
        "A deployment starts and breaks at first use of the missing value.",
        "Add the variables, or take them out of the example, and check them at start.",
        "Both files are compared name by name; values may come from elsewhere.", ("https://12factor.net/config",),
    ),
    "CONFIG-006": Prose(
        "A cookie is set with a protective flag switched off.",
        "Scripts or plain connections can read it.",
        "Sessions can be taken over on shared networks.",
        "Set secure and httpOnly, and a sameSite mode.",
        _SETTING + " or call.", (614, 1004),
    ),
    "CONFIG-007": Prose(
        "Code reads variables that no example file names.",
        "Whoever sets up the service does not know of them.",
        "New stages start with gaps that show late.",
        "Name every variable in the example file.",
        "Names read in code are compared with the example; names built at run time are not seen.",
        ("https://12factor.net/config",),
    ),
    "PKG-001": Prose(
        "A package manifest has no lockfile beside it.",
        "Each installation may choose other versions.",
        "A build of tomorrow can differ from the one that was tested.",
        "Commit the lockfile and install from it.",
        _ABSENT + ": a lockfile of any known manager.", (1357,),
    ),
    "PKG-002": Prose(
        "A dependency stands on the list of refused packages.",
        "It is abandoned, harmful or replaced by a safe one.",
        "Its code runs with all rights of the service.",
        "Replace the package.",
        "The name equals an entry of the list.", (1395,),
    ),
    "PKG-011": Prose(
        "Any version of a dependency is accepted.",
        "A hostile or broken release is installed without notice.",
        "Builds break on the day of someone else's release.",
        "Name a version or a narrow range.",
        "The version is written out in the manifest.", (1357,),
    ),
    "PKG-012": Prose(
        "A dependency is taken from a path, an archive or a code address.",
        "It passes by the checks and digests of the registry.",
        "The address can change its content or go away.",
        "Publish it to a registry, or pin a commit.",
        "The source is written out in the manifest.", (829,),
    ),
    "API-001": Prose(
        "A route loads a resource by an id of the request and nothing checks the caller's right to it.",
        "Callers can read or change what belongs to others by counting ids.",
        "Whole tables can be copied with ordinary requests.",
        "Compare the owner with the session before use, in the query if possible.",
        "Parameter and access are in the file and no known guard is; a guard elsewhere is not seen.", (639,),
    ),
    "API-002": Prose(
        "A file is read or written by a name from the request.",
        "Names with parent steps reach files outside the folder.",
        "Settings and keys of the host can be fetched.",
        "Map ids to names on the server, or resolve the path and test its folder.",
        _INPUT + ".", (22,),
    ),
    "API-003": Prose(
        "The target of a redirect comes from the request.",
        "Links to your host can lead to a foreign one.",
        "Login pages are imitated under your name.",
        "Allow listed targets or paths of your own only.",
        _INPUT + ".", (601,),
    ),
    "API-004": Prose(
        "Answers may be read by scripts of every origin.",
        "Any page can use the interface from a visitor's browser.",
        "Internal interfaces become readable through the browsers of staff.",
        "List the origins that need it.",
        f"{_WORDS}: a star as allowed origin.", (942,),
    ),
    "API-005": Prose(
        "A field that holds a credential is part of an answer.",
        "Clients, caches and logs get to know it.",
        "A single recorded answer is enough to take an account.",
        "Answer with a list of named fields that leaves it out.",
        "Field name and answer stand together; the value behind the name is not seen.", (200,),
    ),
    "AUTH-001": Prose(
        "Client code decides what a user may do.",
        "Users can change the decision in their browser.",
        "Hidden functions are one console line away.",
        "Decide on the server and let the client only show the result.",
        "The file is client code and tests a role or stored right.", (602,),
    ),
    "AUTH-002": Prose(
        "An administrative endpoint shows no check on the server.",
        "Anyone who knows its address can use it.",
        "Scanners try such addresses daily.",
        "Put the routes behind a check of session and role.",
        "The path tells its use and no known check is in the file; one in front of it is not seen.", (306,),
    ),
    "AUTH-003": Prose(
        "A token is accepted without a valid signature.",
        "Callers can write their own tokens with any identity.",
        "No log tells forged sessions from real ones.",
        "Verify each token with a fixed list of signing methods.",
        "Call and option stand in the text; a check elsewhere is not seen.", (347,),
    ),
    "CODE-001": Prose(
        "Text is run as program code.",
        "Whoever shapes the text runs code in the service.",
        "One request can take over the process and its secrets.",
        "Parse data with a parser, or choose from a table of functions.",
        f"{_WORDS}: the call itself.", (95,),
    ),
    "CODE-002": Prose(
        "A function is made from text at run time.",
        "Text from outside becomes code.",
        "Content policies have to be loosened for it, for all pages.",
        "Write the function out, or choose from a table of functions.",
        f"{_WORDS}: the constructor call.", (95,),
    ),
    "CODE-003": Prose(
        "A shell command is put together from strings.",
        "Special characters in a part start further commands.",
        "The host is open with the rights of the service.",
        "Call the program with a list of arguments and no shell.",
        f"{_WORDS}: a process call with joined text.", (78,),
    ),
    "CODE-004": Prose(
        "SQL text is put together from strings.",
        "A part can close the statement and add its own.",
        "Tables can be read, changed or dropped with the rights of the service.",
        "Use placeholders and hand the values over apart.",
        f"{_WORDS}: a statement with joined text.", (89,),
    ),
    "CODE-005": Prose(
        "Text is put into a page as markup.",
        "Scripts in the text run in the visitor's session.",
        "One stored text reaches every visitor.",
        "Set text as text, or clean it with a maintained library.",
        f"{_WORDS}: a sink that takes markup.", (79,),
    ),
    "CODE-006": Prose(
        "Python text is evaluated or executed.",
        "Whoever shapes the text runs code in the service.",
        "Workers share memory and secrets with the code that was let in.",
        "Use a literal parser or a table of functions.",
        f"{_WORDS}: the call itself.", (95,),
    ),
    "CODE-007": Prose(
        "Python starts a command through the shell.",
        "Special characters in a part start further commands.",
        "The host is open with the rights of the service.",
        "Pass a list of arguments and leave the shell off.",
        f"{_WORDS}: a process call with a shell.", (78,),
    ),
    "CODE-008": Prose(
        "Python builds SQL by formatting.",
        "A value can close the statement and add its own.",
        "Tables can be read, changed or dropped with the rights of the service.",
        "Hand values to execute as parameters.",
        f"{_WORDS}: a formatted statement.", (89,),
    ),
    "CODE-009": Prose(
        "Data is loaded by a format that can carry code.",
        "A crafted document runs code when it is loaded.",
        "Queues and caches become a way into every worker.",
        "Load plain data formats, with the safe loader.",
        f"{_WORDS}: an unsafe loader.", (502,),
    ),
    "LOG-001": Prose(
        "A credential is written to the log.",
        "Everyone who can read logs gets it.",
        "Logs are kept for long and copied to other systems.",
        "Log that it was used, never its value.",
        "Name of the value and log call stand in one line.", (532,),
    ),
    "LOG-002": Prose(
        "An answer contains a stack trace.",
        "Callers learn paths, versions and structure.",
        "Each provoked fault tells attackers more.",
        "Log the trace and answer with a number to quote.",
        f"{_WORDS}: a trace in an answer.", (209,),
    ),
    "LOG-003": Prose(
        "The whole environment is written to the log.",
        "All secrets of the process are in it.",
        "One start of the service spreads every key to the log store.",
        "Log chosen names only.",
        f"{_WORDS}: the environment object in a log call.", (532,),
    ),
    "SQL-001": Prose(
        "A request value becomes part of SQL text.",
        "Callers can read or change any row.",
        "Tools find and use such places without help.",
        "Use placeholders and hand the values over apart.",
        _INPUT + ".", (89,),
    ),
    "CMD-001": Prose(
        "A request value becomes part of a command.",
        "Callers can run programs on the host.",
        "The host, its network and its keys are lost with one request.",
        "Use a list of arguments and allow known values only.",
        _INPUT + ".", (78,),
    ),
    "CMD-002": Prose(
        "A command is chosen or put together at run time.",
        "If a part comes from outside, it decides what runs.",
        "What the service runs cannot be told from its code.",
        "Write the command out and pass arguments as a list.",
        "The command is no fixed text; where its parts come from is not seen.", (78,),
    ),
    "PATH-001": Prose(
        "A request value becomes part of a file path.",
        "Parent steps lead out of the folder.",
        "Keys, settings and code of the service can be fetched.",
        "Resolve the path and test that it lies in the folder.",
        _INPUT + ".", (22,),
    ),
    "SSRF-001": Prose(
        "A request value decides where the service sends a request.",
        "Callers reach hosts that only the service can reach.",
        "Addresses of cloud metadata give out keys of the machine.",
        "Allow listed hosts and refuse private addresses after resolving.",
        _INPUT + ".", (918,),
    ),
    "XSS-001": Prose(
        "Markup is set without cleaning.",
        "Scripts run in the session of whoever opens the page.",
        "Accounts of staff are taken over through texts of visitors.",
        "Escape by default and clean wanted markup with a maintained library.",
        "A sink for markup is used and no cleaner stands beside it.", (79,),
    ),
    "AUTHZ-001": Prose(
        "The caller's role is read from the request.",
        "Callers can name the role they want.",
        "Every endpoint behind the role is open.",
        "Take the role from the verified session.",
        _INPUT + ".", (269,),
    ),
    "AUTHZ-002": Prose(
        "A route serves single objects without a test of their owner.",
        "Callers reach objects of others by changing the id.",
        "Data of all customers can be listed by one of them.",
        "Ask for object and owner in one query.",
        "No test stands in the lines that follow; one in front of the route is not seen.", (639,),
    ),
    "AUTH-004": Prose(
        "A password is stored or compared without hashing.",
        "A copy of the table gives all passwords.",
        "Customers use the same password elsewhere.",
        "Hash with a slow, salted function and compare by its own check.",
        "A password is taken and no hashing follows in the next lines.", (256,),
    ),
    "AUTH-005": Prose(
        "A token is signed without an expiry.",
        "A stolen token works for ever.",
        "The only way to end it is a new signing key for all.",
        "Set a short expiry and renew tokens.",
        "The signing call and the lines that follow name no expiry.", (613,),
    ),
    "AUTH-006": Prose(
        "Scripts can read a session cookie.",
        "A single injected script takes the session.",
        "Third-party scripts of a page can read it too.",
        "Set httpOnly for it.",
        f"{_WORDS}: the flag is off.", (1004,),
    ),
    "CORS-001": Prose(
        "Every origin may send requests with credentials.",
        "Foreign pages act in the visitor's session.",
        "Data of logged-in visitors can be read by any page they open.",
        "List the origins that may use credentials.",
        _SETTING + ".", (942,),
    ),
    "CORS-002": Prose(
        "The origin of a request is sent back as allowed.",
        "This allows every origin, with credentials too.",
        "The listed origins protect nothing.",
        "Compare the origin with a list before it is sent back.",
        f"{_WORDS}: the request's origin in the answer's head.", (346, 942),
    ),
    "HDR-001": Prose(
        "A server sets no protective headers.",
        "Browsers allow framing, guessing of types and plain connections.",
        "Faults in pages are easier to use.",
        "Use a header middleware or set the headers in the proxy.",
        _ABSENT + "; a proxy may set them.", (693, "https://owasp.org/www-project-secure-headers/"),
    ),
    "ERR-001": Prose(
        "An error's own text is sent to the caller.",
        "It may name tables, paths and inputs of others.",
        "Provoked faults become a way to look inside.",
        "Log the error and answer with a general message.",
        f"{_WORDS}: the error object in an answer.", (209,),
    ),
    "CFG-001": Prose(
        "An environment file lies at the root of the repository.",
        "Its values are shared with everyone who can clone.",
        "Images and archives of the folder contain it.",
        "Remove it, list it in the ignore file and supply values at start.",
        "The file's own name and place tell what it is.", (538,),
    ),
    "CFG-002": Prose(
        "A mode for development is switched on.",
        "Checks are loosened and details shown.",
        "The service is slower and tells more than it should.",
        "Let the environment choose the mode, strict by default.",
        _SETTING + ".", (489,),
    ),
    "CFG-003": Prose(
        "An address of the local machine is written into code.",
        "The call works on one machine only.",
        "After deployment it fails or reaches something else.",
        "Read the address from the environment.",
        "The address is in the text; it may be a default that is overridden.", ("https://12factor.net/backing-services",),
    ),
    "REL-001": Prose(
        "A file call that waits is used in a server module.",
        "All other requests wait until the disk has answered.",
        "Under load the waiting times add up and health checks fail.",
        "Use the form that gives a promise.",
        "The call is in a file that handles requests.", ("https://nodejs.org/en/learn/asynchronous-work/dont-block-the-event-loop",),
    ),
    "REL-002": Prose(
        "A network call has no time limit.",
        "A partner that hangs holds the caller.",
        "Connections and memory run out while one partner is slow.",
        "Set a limit for each call and retry with care.",
        "Neither the call nor its lines name a limit; a shared client may.", (1088,),
    ),
    "REL-003": Prose(
        "An exception is caught and nothing is done.",
        "The fault stays unknown and the work half done.",
        "Wrong data is found long after its cause has gone.",
        "Handle it, log it or let it pass on.",
        f"{_WORDS}: an empty handler.", (390,),
    ),
    "REL-004": Prose(
        "A chain of promises has no handler for failure.",
        "A failure is reported by the process as a whole, or not at all.",
        "Newer runtimes end the process for it.",
        "Add a handler, or await inside try.",
        "No handler stands in the same lines; one further on is not seen.", (755,),
    ),
    "REL-006": Prose(
        "A container in memory grows and nothing takes out entries.",
        "Memory use rises with every request.",
        "The process is ended for memory at the busiest hour.",
        "Bound it by size or age.",
        "Its declaration is seen; entries may be taken out elsewhere.", (770,),
    ),
    "OBS-001": Prose(
        "A server has no endpoint that tells its health.",
        "Nobody outside can tell a hanging service from a working one.",
        "Traffic goes on to instances that cannot answer.",
        "Add an endpoint that tests what the service needs.",
        _ABSENT + ".", ("https://kubernetes.io/docs/concepts/configuration/liveness-readiness-startup-probes/",),
    ),
    "OBS-002": Prose(
        "A server does not react to the signal to end.",
        "Open requests are cut off.",
        "Every deployment loses some requests.",
        "On the signal, stop accepting, finish and close.",
        _ABSENT + "; a framework may do it.", ("https://12factor.net/disposability",),
    ),
    "OBS-003": Prose(
        "No logging library is used.",
        "Log lines have no level and no fields.",
        "Faults cannot be searched over several instances.",
        "Log by a library, as one record a line.",
        _ABSENT + "; own logging code is not known to the rule.", ("https://12factor.net/logs",),
    ),
    "DEP-001": Prose(
        "A container runs as the superuser.",
        "A fault in the service gives all rights inside the container.",
        "Faults of the runtime then reach the host.",
        "Create a user in the image and switch to it.",
        "The build file names the user, or names none; the base image may.", (250,),
    ),
    "DEP-002": Prose(
        "A base image is named without a fixed version.",
        "Two builds can have different bases.",
        "A roll-back does not bring back what ran before.",
        "Name a version, best with its digest.",
        "The tag is written out in the build file.", (1357, "https://docs.docker.com/build/building/best-practices/"),
    ),
    "DEP-003": Prose(
        "An environment file is copied into an image.",
        "Everyone who can pull the image can read it.",
        "Old layers keep it after it was deleted.",
        "Leave it out by the ignore file and supply values at start.",
        "The copy is written out in the build file.", (538,),
    ),
    "DEP-004": Prose(
        "An image tells no health check.",
        "The runtime knows only whether the process lives.",
        "Hanging containers are kept in service.",
        "Add a check, or a probe of the platform.",
        "The build file has none; the platform may.", ("https://docs.docker.com/reference/dockerfile/#healthcheck",),
    ),
    "DEP-005": Prose(
        "A service runs privileged or in the network of the host.",
        "The wall between container and host is gone.",
        "One service taken over is the host taken over.",
        "Grant single capabilities and publish single ports.",
        _SETTING + ".", (250,),
    ),
    "DEP-006": Prose(
        "A pipeline prints a secret.",
        "Readers of its log get it.",
        "Logs of public projects are public.",
        "Pass the secret to the program that needs it and print nothing.",
        "Secret and print command stand in one line.", (532,),
    ),
    "DEP-007": Prose(
        "A pipeline uses foreign code by a tag that can be moved.",
        "Its owner, or whoever takes the account, can change what runs.",
        "Keys of deployment are within reach of that code.",
        "Pin it to a commit.",
        "The reference is written out in the pipeline.", (829,),
    ),
    "TST-001": Prose(
        "The repository has no tests.",
        "Changes are checked by nobody.",
        "Faults are found by users.",
        "Begin with tests of the main paths.",
        _ABSENT + ".", (1164,),
    ),
    "TST-002": Prose(
        "Tests exist, but the pipeline does not run them.",
        "They can fail for long without notice.",
        "Broken changes are deployed.",
        "Run the tests on every change.",
        "The pipeline files name no known test command.", (1164,),
    ),
    "DAT-001": Prose(
        "A sensitive field is written to the log.",
        "Personal data is read by people who need not know it.",
        "Requests for deletion have to reach log stores too.",
        "Mask the field, or leave it out.",
        "Field name and log call stand in one line.", (532,),
    ),
    "DAT-002": Prose(
        "A secret is part of an address.",
        "Proxies, histories and logs keep addresses.",
        "The secret is sent on to other hosts as the page one came from.",
        "Send it in a header or in the body.",
        f"{_WORDS}: a secret's name as a parameter.", (598,),
    ),
    "DAT-003": Prose(
        "A hash or key is returned to the caller.",
        "Hashes can be tried without limit outside.",
        "All accounts are at risk from one answer.",
        "Answer with a list of named fields that leaves it out.",
        "Field name and answer stand together.", (200,),
    ),
    "CORR": Prose(
        "A route without a check reaches the database, and the same file has a fault that opens it.",
        "Two faults add up to open data.",
        "No login stands between the network and the tables.",
        "Protect the route first, then mend the fault in the file.",
        "Route and finding are in the same file; that the one leads to the other is not proven.", (306, 89),
    ),
}


def prose_of(rule_id: str, title: str, category: str) -> Prose:
    general = Prose(
        f"{title} ({category}).",
        "The rule points at a risk in this place.",
        "Not told for this rule.",
        "Review the place and correct it.",
        "A fixed pattern of this rule matched the source text.",
    )
    return RULE_PROSE.get(rule_id, general)
