"""Incremental reads: outboxes, change feeds and topics, polled lists, webhooks and messages."""
