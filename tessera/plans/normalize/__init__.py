"""Normalisation jobs (N1 to N22): raw variant documents to canonical tables, as lazy plans."""

from tessera.plans.normalize.logs import claude_code_sessions, codex_sessions, gemini_cli_sessions
from tessera.plans.normalize.notebooks import guide_questions, notebook_heads, notebook_messages, notebook_notes, notebook_outputs, notebook_sources, source_guides
from tessera.plans.normalize.projects import assets, project_docs, project_metadata, scheduled_tasks
from tessera.plans.normalize.saves import agent_memories, clipped_notes, pasted_chats, terminal_transcripts
from tessera.plans.normalize.web import SPECS, Spec, conversations, group_links, messages, space_links, tool_events, tree_nodes

__all__ = [
    "SPECS", "Spec", "agent_memories", "assets", "claude_code_sessions", "clipped_notes", "codex_sessions", "conversations", "gemini_cli_sessions", "group_links",
    "guide_questions", "messages", "notebook_heads", "notebook_messages", "notebook_notes", "notebook_outputs", "notebook_sources", "pasted_chats", "project_docs",
    "project_metadata", "scheduled_tasks", "source_guides", "space_links", "terminal_transcripts", "tool_events", "tree_nodes",
]
