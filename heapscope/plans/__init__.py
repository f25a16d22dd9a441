"""heapscope.plans"""
