"""heapscope.operators"""
