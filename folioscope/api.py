"""The library's surface in one place."""

from __future__ import annotations

from folioscope.functions.names import camel_key, slug
from folioscope.operators.findings import as_json, by_file, count_by_level, distinct_ids, filter_findings, full_text, has_errors, line_text, location, render_human, render_json, render_sarif, run_summary
from folioscope.operators.history import debounce, drift, latest, latest_finished, live_state, notification, record_run, transitions, vault_status
from folioscope.operators.infer import as_config, infer, load_inferred
from folioscope.operators.infer import check as check_inferred
from folioscope.operators.navigate import anchors, blocks_of_kind, by_anchor, code_lines, find_section, list_view, section_for_line, section_groups, section_spans, sections_at, table_lines, table_view, text_view
from folioscope.operators.planes import hits as match_text
from folioscope.operators.planes import validate_text
from folioscope.operators.rules import apply as apply_rules
from folioscope.operators.rules import dead_anchor_rule, finding, struct_type, typed_frontmatter, typed_table
from folioscope.operators.validate import CorpusResult, order, read, route, validate, validate_corpus
from folioscope.plans.ddl import DeclarativeError, compile_contract, compile_schema, find_config, inline_config, load_config, load_config_file, load_contract, load_contract_file
from folioscope.plans.grammar import (
    LENIENT, STRICT, Code, Contract, ContractError, CorpusConfig, Gap, Level, List, MaxWords, Route, Rule, Schema, Slot, Table, TextSpec, contract, doc_rule, forbids, gap, lenient_body, one_of, optional, optional_section, requires, rule, section, sections, strict_body, table,
)
from folioscope.sources.document import parse, raw_rows, references
from folioscope.sources.files import load_table, merge_first, page, pre_filter, read_tree, resolve_inside, save_table, upsert
from folioscope.sources.markdown import split_frontmatter
from folioscope.sources.projection import open_table, project

__all__ = [name for name in dir() if not name.startswith("_") and name != "annotations"]
