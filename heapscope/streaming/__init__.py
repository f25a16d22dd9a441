"""heapscope.streaming"""
