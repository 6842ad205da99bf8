"""Writing results, reports and queues."""
