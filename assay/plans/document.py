"""Checks of service descriptions: node rows in, issue rows out.

Every rule is an expression over an object and its fields, evaluated for all
objects of all documents in one projection; rules about several objects are
joins. Documents that can't be parsed give one fatal issue and nothing else.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from assay.functions import grammar, text
from assay.operators import graph
from assay.plans import schema_graph
from assay.sources import nodes as node_source

# The fields that each object may have, besides extensions.
FIELDS = {
    "root": "openapi $self info jsonSchemaDialect servers paths webhooks components security tags externalDocs",
    "info": "title summary description termsOfService contact license version",
    "contact": "name url email",
    "license": "name identifier url",
    "components": "schemas responses parameters examples requestBodies headers securitySchemes links callbacks pathItems mediaTypes",
    "path": "$ref summary description get put post delete options head patch trace query additionalOperations servers parameters",
    "operation": "tags summary description externalDocs operationId parameters requestBody responses callbacks deprecated security servers",
    "response": "summary description headers content links",
    "requestBody": "description content required",
    "media": "description schema itemSchema example examples encoding prefixEncoding itemEncoding",
    "encoding": "contentType headers style explode allowReserved encoding prefixEncoding itemEncoding",
    "example": "summary description value dataValue serializedValue externalValue",
    "tag": "name summary description parent kind externalDocs",
    "externalDocs": "url description",
    "link": "operationRef operationId parameters requestBody description server",
    "server": "url description name variables",
    "serverVariable": "default description enum",
    "discriminator": "propertyName mapping defaultMapping",
    "xml": "nodeType name namespace prefix attribute wrapped",
}
# Fields that must be strings, and booleans, where present.
STRINGS = {
    "root": "openapi $self jsonSchemaDialect",
    "info": "title version summary description termsOfService",
    "contact": "name url email",
    "license": "name identifier url",
    "path": "$ref summary description",
    "operation": "summary description operationId",
    "requestBody": "description",
    "media": "description",
    "encoding": "contentType",
    "example": "summary description serializedValue externalValue",
    "tag": "summary description parent kind",
    "externalDocs": "description",
    "link": "operationRef operationId description",
    "server": "description name",
    "serverVariable": "description",
    "discriminator": "defaultMapping",
    "xml": "name namespace prefix",
    "parameter": "description style",
    "header": "description style",
}
BOOLEANS = {
    "operation": "deprecated",
    "requestBody": "required",
    "parameter": "required deprecated allowEmptyValue explode allowReserved",
    "header": "required deprecated allowEmptyValue explode allowReserved",
}
REQUIRED = {"info": "title version", "license": "name"}
URIS = {"root": "jsonSchemaDialect", "info": "termsOfService", "contact": "url", "license": "url"}
# Styles by parameter location, and of encodings.
STYLES = {"path": "matrix label simple", "query": "form spaceDelimited pipeDelimited deepObject", "header": "simple", "cookie": "form cookie"}
ENCODING_STYLES = "form spaceDelimited pipeDelimited deepObject"
# URLs that OAuth flows need, and fields by security scheme type.
FLOWS = {
    "implicit": "authorizationUrl",
    "password": "tokenUrl",
    "clientCredentials": "tokenUrl",
    "authorizationCode": "authorizationUrl tokenUrl",
    "deviceAuthorization": "deviceAuthorizationUrl tokenUrl",
}
SCHEMES = {"apiKey": "name in", "http": "scheme bearerFormat", "oauth2": "flows oauth2MetadataUrl", "openIdConnect": "openIdConnectUrl", "mutualTLS": ""}
# Keywords of a schema by the kind of value they take.
KEYWORDS = {
    "string": "$id $schema $ref $anchor $dynamicRef $dynamicAnchor $comment title description format pattern contentEncoding contentMediaType",
    "boolean": "deprecated readOnly writeOnly uniqueItems",
    "array": "required enum examples prefixItems allOf anyOf oneOf",
    "object": "properties patternProperties $defs dependentSchemas dependentRequired discriminator xml externalDocs $vocabulary",
    "size": "minLength maxLength minItems maxItems minContains maxContains minProperties maxProperties",
    "number": "minimum maximum exclusiveMinimum exclusiveMaximum multipleOf",
}

_mailbox = grammar.column(grammar.mailbox, BooleanType())
_uri = grammar.column(grammar.uri_reference, BooleanType())
_iri = grammar.column(grammar.non_relative_iri, BooleanType())
_server = grammar.server_template


def _lits(words: str | list[str]) -> Column:
    words = words.split() if isinstance(words, str) else list(words)
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


class _Object:
    """Expressions on one object's fields."""

    def __init__(self):
        self.kids, self.role = F.col("kids"), F.col("role")

    def has(self, key: str) -> Column:
        return F.map_contains_key(self.kids, key)

    def kind(self, key: str) -> Column:
        return F.coalesce(self.kids[key]["kind"], F.lit("absent"))

    def string(self, key: str) -> Column:
        """The field's text; empty where absent or no string."""
        return F.coalesce(self.kids[key]["str"], F.lit(""))

    def size(self, key: str) -> Column:
        return F.coalesce(self.kids[key]["n"], F.lit(0))

    def of_other_kind(self, wanted: str):
        """A test of keys: whether the field is present and of another kind."""
        return lambda k: F.map_contains_key(self.kids, k) & (self.kids[k]["kind"] != wanted)

    def own_keys(self) -> Column:
        return F.filter(F.map_keys(self.kids), lambda k: ~k.startswith("x-"))


def _found(code: str | Column, at: str | Column = "", message: str | Column = "") -> Column:
    parts = [x if isinstance(x, Column) else F.lit(x) for x in (code, at, message)]
    return F.struct(parts[0].alias("code"), parts[1].alias("at"), parts[2].alias("message"))


def _each(keys: Column, code: Column | str, message: str) -> Column:
    """One issue at each of the keys."""
    return F.transform(
        keys, lambda k: _found(code, F.concat(F.lit("/"), text.pointer_escape(k)), F.concat(F.lit(message), k))
    )


def _rules() -> list[Column]:
    """Arrays of issues of one object; null and empty arrays are none."""
    o = _Object()
    role, has, kind, string = o.role, o.has, o.kind, o.string
    none = F.array().cast("array<struct<code:string,at:string,message:string>>")
    out: list[Column] = []

    def rule(applies: Column, code: str | Column, at: str | Column = "", message: str | Column = "") -> None:
        out.append(F.when(applies, F.array(_found(code, at, message))).otherwise(none))

    def is_a(*names: str) -> Column:
        return role.isin(*names)

    def tabled(table: dict[str, str]) -> Column:
        """The words that a table has for the object's role."""
        chain = F.when(F.lit(False), _lits(""))
        for name, words in table.items():
            chain = chain.when(role == name, _lits(words))
        return F.coalesce(chain, _lits(""))

    reference = has("$ref") & is_a(*(r for r in node_source.REFERENCE_ROLES if r not in ("schema", "path")))
    whole = ~reference
    # references
    extra = F.array_except(F.map_keys(o.kids), _lits("$ref summary description"))
    out.append(F.when(reference, _each(extra, "spec.ref.sibling", "a reference has the field ")).otherwise(none))
    # unknown fields
    location = F.when(role == "header", "header").otherwise(string("in"))
    parameter_fields = F.concat(
        _lits("description required deprecated schema content example examples"),
        F.when(role == "parameter", _lits("name in")).otherwise(_lits("")),
        F.when((role == "parameter") & (string("in") == "query"), _lits("allowEmptyValue")).otherwise(_lits("")),
        F.when(has("schema"), _lits("style explode")).otherwise(_lits("")),
        F.when(
            has("schema")
            & (role == "parameter")
            & (string("in").isin("path", "query") | ((string("in") == "cookie") & (~has("style") | (string("style") == "form")))),
            _lits("allowReserved"),
        ).otherwise(_lits("")),
    )
    allowed = F.when(is_a("parameter", "header"), parameter_fields).otherwise(tabled(FIELDS))
    checked = whole & is_a(*FIELDS, "parameter", "header")
    code = F.concat(F.lit("spec."), role, F.lit(".field"))
    out.append(F.when(checked, _each(F.array_except(o.own_keys(), allowed), code, "unknown field: ")).otherwise(none))
    # kinds of present fields
    for table, wanted, suffix in ((STRINGS, "string", ".string"), (BOOLEANS, "boolean", ".boolean")):
        wrong = F.filter(tabled(table), o.of_other_kind(wanted))
        out.append(F.when(whole, _each(wrong, F.concat(F.lit("spec."), role, F.lit(suffix)), "wrong kind of ")).otherwise(none))
    missing = F.filter(tabled(REQUIRED), lambda k: ~F.map_contains_key(o.kids, k))
    out.append(_each(missing, F.concat(F.lit("spec."), role, F.lit(".required")), "missing "))
    for name, keys in URIS.items():
        for key in keys.split():
            bad = ~_uri(string(key)) | ~text.percent_valid(string(key))
            rule((role == name) & (kind(key) == "string") & bad, f"spec.{name}.uri", f"/{key}", "no URI reference")
    # root, info and components
    rule((role == "root") & (string("openapi") != "3.2.0"), "spec.version", "", "version 3.2.0 is required")
    rule((role == "root") & (kind("info") != "object"), "spec.info", "", "info is required")
    rule((role == "root") & ~(has("paths") | has("components") | has("webhooks")), "spec.root.required", "", "no paths, components or webhooks")
    rule((role == "contact") & (kind("email") == "string") & ~_mailbox(string("email")), "spec.contact.email", "/email", "no mailbox")
    rule((role == "license") & has("identifier") & has("url"), "spec.license.conflict", "", "identifier and url")
    named = is_a("schemas", "responseComponents", "parameters", "examples", "requestBodies", "headers", "securitySchemes", "links", "callbacks", "pathItems", "mediaTypes")
    component = named & F.col("path").rlike("^/components/[^/]+$")
    bad_names = F.filter(F.map_keys(o.kids), lambda k: ~text.component_name(k))
    out.append(F.when(component, _each(bad_names, "spec.components.name", "no component name: ")).otherwise(none))
    # paths and operations
    methods = F.col("path").endswith("/additionalOperations") & (role == "additionalOperations")
    out.append(F.when(methods, _each(F.filter(F.map_keys(o.kids), lambda k: ~text.http_token(k)), "spec.method.token", "no method: ")).otherwise(none))
    out.append(F.when(methods, _each(F.filter(F.map_keys(o.kids), text.fixed_method), "spec.method.duplicate", "fixed method: ")).otherwise(none))
    rule((role == "operation") & has("tags") & (kind("tags") != "array"), "spec.operation.tags", "/tags", "no array")
    for owner in ("root", "operation"):
        rule((role == owner) & has("security") & (kind("security") != "array"), "spec.security.requirements", "/security", "no array")
    # parameters
    place = string("in")
    rule(whole & (role == "parameter") & ~place.isin("path", "query", "header", "cookie", "querystring"), "spec.parameter.location", "", "unknown location")
    bad_name = (kind("name") != "string") | ((place == "path") & ((string("name") == "") | string("name").rlike("[{}]")))
    rule(whole & (role == "parameter") & bad_name, "spec.parameter.name", "/name", "no usable name")
    needs = (place == "path") & ~F.coalesce(o.kids["required"]["bool_val"], F.lit(False))
    rule(whole & (role == "parameter") & needs, "spec.parameter.required", "", "a path parameter is required")
    rule(whole & (role == "parameter") & (place == "querystring") & ~has("content"), "spec.parameter.querystring", "", "needs content")
    styles = F.when(F.lit(False), _lits(""))
    for name, words in STYLES.items():
        styles = styles.when(location == name, _lits(words))
    fits = F.coalesce(F.array_contains(styles, string("style")), F.lit(False))
    fielded = whole & is_a("parameter", "header")
    rule(fielded & has("schema") & has("style") & ~fits, "spec.parameter.style", "/style", "style of another location")
    rule(fielded & (has("schema") == has("content")), "spec.parameter.content", "", "exactly one of schema and content")
    rule(fielded & (kind("content") == "object") & (o.size("content") != 1), "spec.parameter.content", "/content", "exactly one media type")
    # bodies, responses and media
    statuses = F.filter(F.map_keys(o.kids), lambda k: ~k.startswith("x-"))
    rule((role == "responses") & ~F.exists(statuses, text.status_key), "spec.response.missing", "", "no response")
    out.append(F.when(role == "responses", _each(F.filter(statuses, lambda k: ~text.status_key(k)), "spec.response.status", "no status: ")).otherwise(none))
    for key in ("summary", "description"):
        rule(whole & (role == "response") & has(key) & (kind(key) != "string"), f"spec.response.{key}", "", "no string")
    rule(whole & (role == "requestBody") & ((kind("content") != "object") | (o.size("content") == 0)), "spec.request.content", "", "no media type")
    positional = has("prefixEncoding") | has("itemEncoding")
    rule(whole & is_a("media", "encoding") & has("encoding") & positional, "spec.encoding.conflict", "", "named and positional")
    rule(whole & is_a("media", "parameter", "header") & has("example") & has("examples"), "spec.example.conflict", "", "example and examples")
    known_style = F.array_contains(_lits(ENCODING_STYLES), string("style"))
    rule((role == "encoding") & has("style") & ~known_style, "spec.encoding.style", "/style", "unknown style")
    for key in ("explode", "allowReserved"):
        rule((role == "encoding") & has(key) & (kind(key) != "boolean"), "spec.encoding.boolean", f"/{key}", "no boolean")
    rule((role == "encoding") & has("headers") & (kind("headers") != "object"), "spec.encoding.headers", "/headers", "no map")
    represented = has("dataValue") | has("serializedValue") | has("externalValue")
    rule(whole & (role == "example") & has("value") & represented, "spec.example.conflict", "", "value and another form")
    rule(whole & (role == "example") & has("serializedValue") & has("externalValue"), "spec.example.conflict", "", "two forms")
    # links, tags, servers
    rule(whole & (role == "link") & (has("operationRef") == has("operationId")), "spec.link.target", "", "exactly one target")
    rule(whole & (role == "link") & has("parameters") & (kind("parameters") != "object"), "spec.link.parameters", "/parameters", "no map")
    rule((role == "tag") & (kind("name") != "string"), "spec.tag.name", "/name", "no string")
    docs_url = (kind("url") != "string") | ~_uri(string("url"))
    rule((role == "externalDocs") & docs_url, "spec.externalDocs.url", "/url", "no URI reference")
    problem = F.when(kind("url") == "string", _server(string("url"))).otherwise("url")
    rule((role == "server") & problem.isNotNull(), F.concat(F.lit("spec.server."), problem), "/url", "no URL template")
    rule((role == "serverVariable") & (kind("default") != "string"), "spec.serverVariable.default", "/default", "no string")
    no_list = has("enum") & ((kind("enum") != "array") | (o.size("enum") == 0))
    rule((role == "serverVariable") & no_list, "spec.serverVariable.enum", "/enum", "no list")
    # discriminators and XML
    rule((role == "discriminator") & (kind("propertyName") != "string"), "spec.discriminator.propertyName", "/propertyName", "no string")
    rule((role == "discriminator") & has("mapping") & (kind("mapping") != "object"), "spec.discriminator.mapping", "/mapping", "no map")
    node = (kind("nodeType") == "string") & string("nodeType").isin("element", "attribute", "text", "cdata", "none")
    rule((role == "xml") & has("nodeType") & ~node, "spec.xml.nodeType", "/nodeType", "unknown node type")
    rule((role == "xml") & has("nodeType") & (has("attribute") | has("wrapped")), "spec.xml.conflict", "", "nodeType and an older field")
    for key in ("attribute", "wrapped"):
        rule((role == "xml") & has(key) & (kind(key) != "boolean"), "spec.xml.boolean", f"/{key}", "no boolean")
    rule((role == "xml") & (kind("namespace") == "string") & ~_iri(string("namespace")), "spec.xml.namespace", "/namespace", "relative")
    # security schemes
    scheme = string("type")
    secured = whole & (role == "security")
    bearer = F.lower(string("scheme")) == "bearer"
    extra_fields = F.when(F.lit(False), _lits(""))
    for name, words in SCHEMES.items():
        words = _lits(words) if name != "http" else F.when(bearer, _lits(words)).otherwise(_lits("scheme"))
        extra_fields = extra_fields.when(scheme == name, words)
    usable = F.concat(_lits("type description deprecated"), F.coalesce(extra_fields, _lits("")))
    out.append(F.when(secured, _each(F.array_except(o.own_keys(), usable), "spec.security.field", "field of another scheme: ")).otherwise(none))
    rule(secured & ~scheme.isin(*SCHEMES), "spec.security.type", "/type", "unknown type")
    keyed = (string("name") != "") & place.isin("header", "query", "cookie")
    rule(secured & (scheme == "apiKey") & ~keyed, "spec.security.apiKey", "", "needs a name and a location")
    rule(secured & (scheme == "http") & (string("scheme") == ""), "spec.security.http", "/scheme", "needs a scheme")
    rule(secured & (scheme == "oauth2") & (kind("flows") != "object"), "spec.security.oauth2", "/flows", "needs flows")
    rule(secured & (scheme == "openIdConnect") & ~has("openIdConnectUrl"), "spec.security.openId", "/openIdConnectUrl", "needs a URL")
    for key in ("description", "bearerFormat"):
        rule(secured & has(key) & (kind(key) != "string"), "spec.security.string", f"/{key}", "no string")
    rule(secured & has("deprecated") & (kind("deprecated") != "boolean"), "spec.security.deprecated", "/deprecated", "no boolean")
    for key in ("openIdConnectUrl", "oauth2MetadataUrl"):
        plain = string(key).rlike("(?i)^[a-z][a-z0-9+.-]*:") & ~string(key).rlike("(?i)^https://[^/?#]")
        bad = has(key) & ((kind(key) != "string") | ~_uri(string(key)) | plain)
        rule(secured & bad, "spec.security.url", f"/{key}", "no HTTPS URL")
    # schema keywords
    schema = role == "schema"
    rule(schema & has("nullable"), "spec.schema.nullable", "/nullable", "use a union with null")
    for wanted in ("string", "boolean", "array", "object"):
        keys = _lits(KEYWORDS[wanted])
        wrong = F.filter(keys, o.of_other_kind(wanted))
        out.append(F.when(schema, _each(wrong, "spec.schema.keyword", "wrong kind of ")).otherwise(none))
    traits = lambda k: text.number_traits(F.coalesce(o.kids[k]["num_text"], F.lit("x")))
    size = F.filter(
        _lits(KEYWORDS["size"]),
        lambda k: F.map_contains_key(o.kids, k)
        & ~F.coalesce(traits(k)["integer"] & (~traits(k)["negative"] | traits(k)["zero"]), F.lit(False)),
    )
    out.append(F.when(schema, _each(size, "spec.schema.keyword", "no size: ")).otherwise(none))
    numbers = F.filter(_lits(KEYWORDS["number"]), lambda k: F.map_contains_key(o.kids, k) & (o.kids[k]["kind"] != "number"))
    out.append(F.when(schema, _each(numbers, "spec.schema.keyword", "no number: ")).otherwise(none))
    step = traits("multipleOf")
    not_positive = (kind("multipleOf") == "number") & (step["zero"] | step["negative"])
    rule(schema & not_positive, "spec.schema.keyword", "/multipleOf", "not above zero")
    typed = (kind("type") == "array") | ((kind("type") == "string") & text.simple_type(string("type")))
    rule(schema & has("type") & ~typed, "spec.schema.keyword", "/type", "no type")
    return out


#: Objects of these roles must be objects; a schema may be a boolean.
_OBJECT_ROLES = [r for r in {*node_source.FIELD_ROLES, *node_source.ENTRY_ROLES.values(), *node_source.ENTRY_ROLES, "security", "externalDocs", "contact", "license", "discriminator", "xml"} if r not in ("schema",)]
_ARRAY_CODES = {"tagArray": "tag.array", "encodingArray": "encoding.prefix", "serverArray": "server.array", "parameterArray": "parameter.array", "schemaArray": "schema.keyword"}

_ISSUE = ["doc", "code", "path", "message"]


def _issue(df: DataFrame, code: str | Column, path: str | Column, message: str) -> DataFrame:
    code = code if isinstance(code, Column) else F.lit(code)
    path = F.col(path) if isinstance(path, str) else path
    return df.select("doc", code.alias("code"), path.alias("path"), F.lit(message).alias("message"))


def shape_issues(nodes: DataFrame) -> DataFrame:
    """Values whose kind doesn't fit their role."""
    wrong = nodes.where(F.col("role").isin(sorted(_OBJECT_ROLES)) & (F.col("kind") != "object"))
    out = _issue(wrong, "spec.object", "path", "an object is required")
    bad_schema = nodes.where((F.col("role") == "schema") & ~F.col("kind").isin("object", "boolean"))
    code = F.when(F.col("kind") == "array", "spec.schema.keyword").otherwise("spec.object")
    out = out.unionByName(_issue(bad_schema, code, "path", "a schema is an object or a boolean"))
    sizes = nodes.where("parent is not null").groupBy("doc", F.col("parent").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    for role, suffix in _ARRAY_CODES.items():
        own = nodes.where(F.col("role") == role)
        out = out.unionByName(_issue(own.where("kind <> 'array'"), f"spec.{suffix}", "path", "an array is required"))
        if role == "schemaArray":
            empty = own.where("kind = 'array'").join(sizes, ["doc", "path"], "left_anti")
            out = out.unionByName(_issue(empty, f"spec.{suffix}", "path", "no schema in the array"))
    return out


def object_issues(objects: DataFrame) -> DataFrame:
    """All rules about single objects in one projection."""
    found = objects.select("doc", "path", F.explode(F.concat(*_rules())).alias("i"))
    return found.select("doc", "i.code", F.concat("path", "i.at").alias("path"), "i.message")


def path_issues(objects: DataFrame, nodes: DataFrame) -> DataFrame:
    """Path templates: grammar, equal shapes, and parameters that are missing or unused."""
    keys = nodes.where("parent = '/paths' and role = 'path'").select("doc", "path", F.col("key").alias("template"))
    out = _issue(keys.where(~text.path_template_valid(F.col("template"))), "spec.path", "path", "no path template")
    shapes = keys.withColumn("shape", text.path_shape(F.col("template")))
    firsts = shapes.groupBy("doc", "shape").agg(F.min("path").alias("first"))
    same = shapes.join(firsts, ["doc", "shape"]).where("path > first")
    out = out.unionByName(_issue(same, "spec.paths.identical", "path", "the same hierarchy as an earlier path"))
    names = keys.select("doc", "path", F.explode(text.path_parameters(F.col("template"))).alias("name")).distinct()
    operations = objects.where("role = 'operation'").select("doc", F.col("path").alias("operation"), text.pointer_parent(F.col("path")).alias("path"))
    wanted = operations.join(names, ["doc", "path"])
    parameters = objects.where(F.col("role") == "parameter").select(
        "doc",
        F.regexp_replace("path", "/parameters/[0-9]+$", "").alias("owner"),
        F.col("kids")["name"]["str"].alias("name"),
        F.col("kids")["in"]["str"].alias("place"),
        F.map_contains_key("kids", "$ref").alias("refers"),
    )
    declared = parameters.where("place = 'path'")
    on_path = declared.select("doc", F.col("owner").alias("path"), "name")
    on_operation = declared.select("doc", F.col("owner").alias("operation"), "name")
    # operations whose parameters are references are left to the reference checks
    unknown = parameters.where("refers").select("doc", "owner")
    lost = wanted.join(on_path, ["doc", "path", "name"], "left_anti").join(on_operation, ["doc", "operation", "name"], "left_anti")
    lost = lost.join(unknown.withColumnRenamed("owner", "operation"), ["doc", "operation"], "left_anti")
    lost = lost.join(unknown.withColumnRenamed("owner", "path"), ["doc", "path"], "left_anti")
    out = out.unionByName(_issue(lost, "spec.parameter.path.missing", "operation", "a template name has no parameter"))
    unused = on_operation.join(operations, ["doc", "operation"]).join(keys.select("doc", "path"), ["doc", "path"], "left_semi")
    unused = unused.join(names, ["doc", "path", "name"], "left_anti")
    return out.unionByName(_issue(unused, "spec.parameter.path.unused", "operation", "a path parameter is not in the template"))


def identity_issues(objects: DataFrame) -> DataFrame:
    """Operation ids, parameters and tags that occur twice; links to unknown operations; tag hierarchies."""
    ids = objects.where("role = 'operation'").select("doc", "path", F.col("kids")["operationId"]["str"].alias("id")).where("id is not null")
    counts = ids.groupBy("doc", "id").agg(F.min("path").alias("first"), F.count(F.lit(1)).alias("n"))
    again = ids.join(counts, ["doc", "id"]).where("path > first")
    out = _issue(again, "spec.operationId.duplicate", "path", "the operation id is taken")
    links = objects.where("role = 'link'").select("doc", "path", F.col("kids")["operationId"]["str"].alias("id")).where("id is not null")
    lost = links.join(counts.where("n = 1").select("doc", "id"), ["doc", "id"], "left_anti")
    out = out.unionByName(_issue(lost, "spec.link.operationId", "path", "the link needs exactly one operation"))
    named = objects.where(F.col("role") == "parameter").select(
        "doc",
        "path",
        F.regexp_replace("path", "/[0-9]+$", "").alias("owner"),
        F.col("kids")["in"]["str"].alias("place"),
        F.col("kids")["name"]["str"].alias("name"),
    )
    named = named.where("name is not null and place is not null and path rlike '/parameters/[0-9]+$'")
    firsts = named.groupBy("doc", "owner", "place", "name").agg(F.min("path").alias("first"))
    twice = named.join(firsts, ["doc", "owner", "place", "name"]).where("path > first")
    out = out.unionByName(_issue(twice, "spec.parameter.duplicate", "path", "the parameter is declared twice"))
    tags = objects.where("role = 'tag'").select("doc", "path", F.col("kids")["name"]["str"].alias("tag"), F.col("kids")["parent"]["str"].alias("up"))
    sep = "\u0001"
    scoped = tags.where("tag is not null").select(
        F.concat("doc", F.lit(sep), "tag").alias("name"), F.concat("doc", F.lit(sep), "up").alias("parent")
    )
    found = graph.hierarchy_issues(scoped).select(
        F.substring_index("name", sep, 1).alias("doc"), "code", F.substring_index("name", sep, -1).alias("tag")
    )
    at = tags.groupBy("doc", "tag").agg(F.max("path").alias("path"))
    placed = found.join(at, ["doc", "tag"])
    return out.unionByName(_issue(placed, F.concat(F.lit("spec."), F.col("code")), "path", "the tags' hierarchy"))


def item_issues(objects: DataFrame, nodes: DataFrame) -> DataFrame:
    """Arrays of plain values: tags, scopes, types, required names and enumerations."""
    items = nodes.where("parent is not null").groupBy("doc", F.col("parent").alias("path")).agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "kind", "str"))).alias("items")
    )
    none = F.array().cast(items.schema["items"].dataType)
    arrays = nodes.where("kind = 'array' and parent is not null").select("doc", "path", "parent", "key").join(items, ["doc", "path"], "left")
    arrays = arrays.withColumn("items", F.coalesce("items", none))
    owners = objects.select("doc", F.col("path").alias("parent"), "role", "kids")
    met = arrays.join(owners, ["doc", "parent"])
    texts = F.transform("items", lambda x: x["str"])
    strings = F.forall("items", lambda x: x["kind"] == "string")
    unique = strings & text.all_unique(texts)
    key, role = F.col("key"), F.col("role")
    simple = unique & (F.size("items") > 0) & F.forall(texts, text.simple_type)
    default = F.col("kids")["default"]["str"]
    code = (
        F.when((role == "operation") & (key == "tags") & ~strings, "spec.operation.tags")
        .when((role == "schema") & (key == "required") & ~unique, "spec.schema.keyword")
        .when((role == "schema") & (key == "type") & ~simple, "spec.schema.keyword")
        .when((role == "serverVariable") & (key == "enum") & ~strings, "spec.serverVariable.enum")
        .when(
            (role == "serverVariable") & (key == "enum") & (F.size("items") > 0) & default.isNotNull() & ~F.array_contains(texts, default),
            "spec.serverVariable.default",
        )
        .when(
            role.isin("root", "operation") & (key == "security") & F.exists("items", lambda x: x["kind"] != "object"),
            "spec.security.requirements",
        )
    )
    out = _issue(met.withColumn("code", code).where("code is not null"), F.col("code"), "path", "unfit values in the array")
    # scopes: entries of the objects in a security array
    entry = nodes.where(F.col("path").rlike("/security/[0-9]+/[^/]+$") & F.col("role").isNull())
    owned = entry.withColumn("owner", F.regexp_replace("path", "/security/[0-9]+/[^/]+$", "")).join(
        objects.where(F.col("role").isin("root", "operation")).select("doc", F.col("path").alias("owner")), ["doc", "owner"], "left_semi"
    )
    scopes = owned.join(items, ["doc", "path"], "left")
    bad = (F.col("kind") != "array") | F.exists(F.coalesce("items", none), lambda x: x["kind"] != "string")
    return out.unionByName(_issue(scopes.where(bad), "spec.security.scopes", "path", "scopes are an array of strings"))


def flow_issues(objects: DataFrame) -> DataFrame:
    """OAuth flows: kinds, fields, URLs and scopes."""
    flows = objects.where(F.col("role").isin("oauthFlows", "oauthFlow"))
    kinds = flows.where("role = 'oauthFlows'").select(
        "doc", "path", F.explode(F.filter(F.map_keys("kids"), lambda k: ~k.isin(*FLOWS) & ~k.startswith("x-"))).alias("k")
    )
    out = _issue(kinds, "spec.security.flow", F.concat("path", F.lit("/"), text.pointer_escape(F.col("k"))), "unknown flow")
    one = flows.where("role = 'oauthFlow'").withColumn("flow", F.element_at(F.split("path", "/"), -1)).where(F.col("flow").isin(*FLOWS))
    needs = F.when(F.lit(False), _lits(""))
    for name, words in FLOWS.items():
        needs = needs.when(F.col("flow") == name, _lits(words))
    one = one.withColumn("needs", needs)
    extra = F.filter(
        F.array_except(F.map_keys("kids"), F.concat(_lits("scopes refreshUrl"), F.col("needs"))), lambda k: ~k.startswith("x-")
    )
    named = one.select("doc", "path", "flow", F.explode(extra).alias("k"))
    out = out.unionByName(_issue(named, "spec.security.field", F.concat("path", F.lit("/"), text.pointer_escape(F.col("k"))), "field of another flow"))
    lost = one.select("doc", "path", "flow", F.explode(F.array_except("needs", F.map_keys("kids"))).alias("k"))
    code = F.when(F.col("flow") == "deviceAuthorization", "spec.security.device").otherwise("spec.security.flow.required")
    out = out.unionByName(_issue(lost, code, F.concat("path", F.lit("/"), F.col("k")), "a URL is required"))
    given = F.array_intersect(F.concat(_lits("refreshUrl"), F.col("needs")), F.map_keys("kids"))
    urls = one.select("doc", "path", F.explode(given).alias("k"), "kids").withColumn("url", F.col("kids")[F.col("k")]["str"])
    plain = F.col("url").rlike("(?i)^[a-z][a-z0-9+.-]*:") & ~F.col("url").rlike("(?i)^https://[^/?#]")
    bad = urls.where(F.col("url").isNull() | plain | ~F.coalesce(_uri(F.coalesce("url", F.lit(""))), F.lit(False)))
    out = out.unionByName(_issue(bad, "spec.security.url", F.concat("path", F.lit("/"), F.col("k")), "no HTTPS URL"))
    scopeless = one.where(~F.coalesce(F.col("kids")["scopes"]["kind"] == "object", F.lit(False)))
    return out.unionByName(_issue(scopeless, "spec.security.scopes", F.concat("path", F.lit("/scopes")), "scopes are required"))


def references(objects: DataFrame, nodes: DataFrame) -> DataFrame:
    """``doc, path, role, ref, target, code``: each reference, where it leads, and what is wrong with it.

    Pointers and anchors of the same document are resolved by equi-joins;
    anything else is never fetched.
    """
    uses = objects.where(F.col("role").isin(*node_source.REFERENCE_ROLES)).select(
        "doc", "path", "role", "base", F.col("kids")["$ref"]["str"].alias("ref")
    )
    uses = uses.where("ref is not null")
    fragment = F.when(F.col("ref").startswith("#"), F.substr("ref", F.lit(2)))
    uses = uses.withColumn("pointer", F.when((fragment == "") | fragment.startswith("/"), fragment))
    uses = uses.withColumn("anchor", F.when(F.col("pointer").isNull(), fragment))
    targets = nodes.select("doc", F.col("path").alias("pointer"), F.col("path").alias("by_pointer"), F.col("role").alias("target_role"))
    anchors = objects.where("role = 'schema'").select(
        "doc", "base", F.col("kids")["$anchor"]["str"].alias("anchor"), F.col("path").alias("by_anchor")
    )
    anchors = anchors.where("anchor is not null").groupBy("doc", "base", "anchor").agg(F.min("by_anchor").alias("by_anchor"))
    met = uses.join(targets, ["doc", "pointer"], "left").join(anchors, ["doc", "base", "anchor"], "left")
    target = F.coalesce("by_pointer", "by_anchor")
    code = (
        F.when(F.col("pointer").isNull() & F.col("anchor").isNull(), "spec.external.denied")
        .when(F.col("pointer").isNotNull() & ~text.pointer_valid(F.col("pointer")), "spec.ref.pointer")
        .when(target.isNull(), "spec.ref.missing")
        .when(F.col("by_pointer").isNotNull() & ~F.col("target_role").eqNullSafe(F.col("role")), "spec.ref.type")
    )
    return met.select("doc", "path", "role", "ref", target.alias("target"), code.alias("code"))


def component_edges(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges between schema components, and the components that are used from elsewhere, as ``doc`` + NUL + name."""
    sep = "\u0001"
    name = "^/components/schemas/([^/]+)"

    def at(c: str) -> Column:
        return F.when(F.col(c).rlike(name), F.concat("doc", F.lit(sep), F.regexp_extract(c, name, 1)))

    both = found.where("code is null").select(at("path").alias("src"), at("target").alias("dst")).where("dst is not null")
    edges = both.where("src is not null and src <> dst")
    seeds = both.where("src is null").select(F.col("dst").alias("node")).distinct()
    return edges, seeds


def unused_components(objects: DataFrame, found: DataFrame) -> DataFrame:
    """``doc, name`` of schema components that no reference from outside reaches."""
    edges, seeds = component_edges(found)
    kept = graph.reachable(edges, seeds)
    names = objects.where("path = '/components/schemas'").select("doc", F.explode(F.map_keys("kids")).alias("name"))
    keyed = names.withColumn("node", F.concat("doc", F.lit("\u0001"), text.pointer_escape(F.col("name"))))
    return keyed.join(kept.select("node"), "node", "left_anti").select("doc", "name")


def check(docs: DataFrame) -> DataFrame:
    """``doc, code, path, message`` of all issues of ``docs(doc, content)``, sorted.

    A document that can't be parsed gives ``spec.json`` only.
    """
    nodes = graph.cut(node_source.parsed(docs, roles=True))
    fatal = nodes.where("kind = 'fatal'").select("doc", F.lit("spec.json").alias("code"), "path", F.col("str").alias("message"))
    nodes = nodes.where("kind <> 'fatal'")
    objects = graph.cut(node_source.objects_of(nodes))
    found = graph.cut(references(objects, nodes))
    broken = found.where("code is not null")
    parts = [
        fatal,
        shape_issues(nodes),
        object_issues(objects),
        path_issues(objects, nodes),
        identity_issues(objects),
        item_issues(objects, nodes),
        flow_issues(objects),
        schema_graph.discriminator_issues(objects, nodes, found),
        schema_graph.encoding_issues(objects, nodes, found),
        schema_graph.xml_issues(objects, nodes),
        broken.select("doc", "code", "path", F.col("ref").alias("message")),
    ]
    return reduce(DataFrame.unionByName, (p.select(*_ISSUE) for p in parts)).orderBy("doc", "path", "code", "message")


def sample_documents(pages: DataFrame) -> DataFrame:
    """A small description for each page; every third has planted faults."""
    path = F.regexp_extract("url", "://[^/?#]*(/[^?#]*)", 1)
    faulty = F.col("page_id") % 3 == 0
    status = F.when(faulty, "600").otherwise("200")
    ref = F.when(faulty, "#/components/schemas/Lost").otherwise("#/components/schemas/Page")
    content = F.concat(
        F.lit('{"openapi":"3.2.0","info":{"title":"Page","version":"1"},"paths":{"'),
        path,
        F.lit('/{id}":{"get":{"operationId":"read","parameters":[{"name":"id","in":"path","required":true,"schema":{"type":"string"}}],"responses":{"'),
        status,
        F.lit('":{"description":"ok","content":{"application/json":{"schema":{"$ref":"'),
        ref,
        F.lit('"}}}}}}}},"components":{"schemas":{"Page":{"type":"object","properties":{"id":{"type":"string","minLength":1}}}}}}'),
    )
    return pages.select(F.col("page_id").cast("string").alias("doc"), content.alias("content"))
