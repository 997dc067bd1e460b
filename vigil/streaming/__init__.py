"""Streaming.

Intentionally empty: the detector being re-implemented reads nothing
incrementally (no watermark, window, state or late data). Batch jobs in
``vigil.plans`` cover its whole surface.
"""
