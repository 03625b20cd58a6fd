"""JSON schemas made plain for model providers."""

from __future__ import annotations

import copy

_BOUNDS = ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "minItems", "maxItems", "pattern", "format", "default", "title")


def flattened(schema: dict) -> dict:
    """The schema with every reference to its definitions written out; a schema that refers to itself is an error."""
    definitions = schema.get("$defs", {}) | schema.get("definitions", {})

    def walk(node, open_names: tuple[str, ...]):
        if isinstance(node, list):
            return [walk(x, open_names) for x in node]
        if not isinstance(node, dict):
            return node
        if "$ref" in node:
            name = node["$ref"].rsplit("/", 1)[-1]
            if name in open_names:
                raise ValueError(f"{name} refers to itself")
            rest = {k: v for k, v in node.items() if k != "$ref"}
            return walk(copy.deepcopy(definitions[name]) | rest, (*open_names, name))
        return {k: walk(v, open_names) for k, v in node.items() if k not in ("$defs", "definitions")}

    return walk(schema, ())


def strict(schema: dict) -> dict:
    """Without bounds and defaults; objects take no other properties and require all of theirs."""

    def walk(node, inside_properties: bool = False):
        if isinstance(node, list):
            return [walk(x) for x in node]
        if not isinstance(node, dict):
            return node
        out = {k: walk(v, k == "properties") for k, v in node.items() if inside_properties or k not in _BOUNDS}
        if not inside_properties and out.get("type") == "object":
            out |= {"additionalProperties": False, "required": list(out.get("properties", {}))}
        return out

    return walk(schema)
